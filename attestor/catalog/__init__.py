"""Registered queries by subject: name -> (function of (spark, sf_dir), DuckDB statement or None)."""
