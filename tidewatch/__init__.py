"""Network-flow detection as Spark DataFrame and Structured Streaming operators."""
