"""Document analytics on Spark: search, scoring, evaluation and data preparation as lazy DataFrame plans."""
