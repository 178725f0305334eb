"""Urban settlement analytics as Spark DataFrame operators."""
