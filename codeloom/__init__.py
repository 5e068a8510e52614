"""codeloom: code-intelligence analytics as PySpark DataFrame operators."""
