"""Table sources and sinks: parquet tables, the survey CSV (read and write),
and the survey-shaped fixture view over the driver's tables."""
