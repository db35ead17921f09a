"""fieldloom: ordered event streams to leak-safe feature tables, as Spark DataFrame plans."""
