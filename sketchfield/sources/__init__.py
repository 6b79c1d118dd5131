"""Where filters are kept: Parquet tables with metadata, and JSON."""
