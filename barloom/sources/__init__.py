"""Readers and writers: Parquet layouts, CSV/ZIP ingest, keyed merges."""
