"""tidemark: clickstream and dynamic-pricing analytics composed from Spark operators."""
