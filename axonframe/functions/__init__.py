"""Column-level expressions and Arrow-batched distribution functions."""
