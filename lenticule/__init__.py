"""Spark-first analytics for multi-view image strips and the relations behind them."""
