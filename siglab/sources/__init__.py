"""Where panels come from: generated walks, CSV and Parquet files, the driver's tables; and the gates they pass."""
