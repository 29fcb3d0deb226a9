"""deflow: value-flow (nullability) analytics over source code, written as Spark jobs."""
