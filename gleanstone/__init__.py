"""gleanstone: behavioural-evidence analytics as composable Spark DataFrame operators."""
