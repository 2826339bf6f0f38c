"""Relational operators: DataFrame in, DataFrame out. Only ``bounded_sample`` starts a job."""
