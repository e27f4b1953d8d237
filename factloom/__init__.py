"""PySpark-native analytics over evidence-grounded documents, facts and claims."""
