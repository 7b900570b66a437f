"""Parquet exports, persisted cells, retention and synthetic events."""
