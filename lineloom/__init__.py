"""Assembly-line analytics as Spark DataFrame operators."""
