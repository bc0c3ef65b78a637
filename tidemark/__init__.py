"""tidemark: event detection over noisy time series as composable Spark DataFrame operators."""
