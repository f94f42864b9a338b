"""Behavioural traffic analytics on Spark: DataFrame operators, sources, scalar functions, job plans and streams."""
