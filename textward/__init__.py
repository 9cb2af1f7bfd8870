"""Text-safety analytics for Spark: findings, verdicts, redaction, repair and streams."""
