"""tidelog: versioned, append-oriented tables and their analytics, as Spark DataFrame operators."""
