"""Operators: DataFrame in, DataFrame out, all lazy unless their docstring says otherwise."""
