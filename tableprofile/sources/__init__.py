"""Reading and writing tables, and ingesting datasets and document files."""
