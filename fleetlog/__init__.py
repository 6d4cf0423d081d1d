"""Session-log analytics as PySpark DataFrame operators."""
