"""Spark-native analytics of text as meaning graphs: parsing, alignment, extraction, training, evaluation."""
