"""Set-returning and relational operators: DataFrame in, DataFrame out."""
