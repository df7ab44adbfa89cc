"""Query shapes, chart data, statistics on results and run-log analytics."""
