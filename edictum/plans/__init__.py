"""Rule documents, and compiling them to Spark expressions."""
