"""Folioflow: a Spark-native engine for document field extraction and batch analytics."""
