"""lorekeep: document-knowledge analytics as composable Spark DataFrame operators."""
