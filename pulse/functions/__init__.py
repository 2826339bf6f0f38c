"""Column functions: no function here starts a Spark job."""
