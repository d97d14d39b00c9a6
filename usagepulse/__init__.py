"""Product-usage analytics as lazy Spark DataFrame operators."""
