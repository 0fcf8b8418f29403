"""Annotation analytics on Spark: DataFrame-to-DataFrame operators over video labels."""
