"""Readers for raw dumps and Parquet, and the Parquet writers."""
