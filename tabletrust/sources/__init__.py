"""Reading files and tables, and publishing them."""
