"""Sources and sinks: CSV ingest, tiered parquet tables, test-data adapters."""
