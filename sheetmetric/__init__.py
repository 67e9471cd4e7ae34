"""Quantity take-off and drawing review over large drawing corpora, on Spark DataFrames."""
