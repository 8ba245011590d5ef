"""SQL statements of the operators, for checking the Spark results against DuckDB."""
