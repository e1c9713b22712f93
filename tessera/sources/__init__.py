"""Sources and sinks: given tables, ratings CSV, Parquet staging, event logs."""
