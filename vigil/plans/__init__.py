"""End-to-end jobs and the query catalog (name -> Spark job, DuckDB oracle)."""
