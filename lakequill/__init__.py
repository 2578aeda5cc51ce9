"""lakequill: an analytical SQL engine over Parquet directories, built on Spark."""
