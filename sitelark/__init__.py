"""Site analytics on Spark: sequence scans, interval joins, signal scores, mixture fits and their evaluation."""
