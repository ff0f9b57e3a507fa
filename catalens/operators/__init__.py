"""Dataset operators: DataFrame in, lazy DataFrame out."""
