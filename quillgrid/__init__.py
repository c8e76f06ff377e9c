"""Spark-native worksheet analytics: a spreadsheet's query vocabulary over DataFrames."""
