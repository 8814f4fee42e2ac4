"""Sources: sample tables from parquet, and binary readers."""
