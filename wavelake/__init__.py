"""Spark-native trace analytics: signals, transactions, hierarchies and derived signals as DataFrames."""
