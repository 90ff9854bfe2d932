"""Grounded-story analytics on Spark: DataFrame operators for multi-image narrative datasets."""
