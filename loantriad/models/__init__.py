"""Classifiers on pyspark.ml with the usual fit / transform."""
