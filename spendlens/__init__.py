"""Marketing return-on-investment analytics as Spark DataFrame operators."""
