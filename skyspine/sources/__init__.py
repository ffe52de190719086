"""Scans of landed files and the stored Parquet tables."""
