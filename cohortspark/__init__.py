"""Event-history cohort analytics as plain PySpark DataFrame operators."""
