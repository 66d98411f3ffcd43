"""Readers: Parquet tables, JSON row batches, collection snapshots."""
