"""Checks, discovery, treatments, enrichment, profiles and keys."""
