"""Market microstructure jobs on Spark: books, trades, series, change tests, streams."""
