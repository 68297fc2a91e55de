"""Data operators: DataFrame in, DataFrame out."""
