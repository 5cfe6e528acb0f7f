"""lakeproof: build a layered data lake on Spark and prove that its tables are right."""
