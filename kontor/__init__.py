"""kontor: transaction analytics as composable Spark DataFrame operators."""
