"""Typed files in, parquet / CSV / catalog tables out."""
