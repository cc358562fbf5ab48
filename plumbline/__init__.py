"""Statistical-validation analytics as composable Spark DataFrame transformations."""
