"""Evidence-graph analytics on Spark: DataFrame in, DataFrame out."""
