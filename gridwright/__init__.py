"""Spark-native engine for tables locked inside HTML filings."""
