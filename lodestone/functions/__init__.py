"""Column builders with the reference's semantics where Spark's own functions differ."""
