"""Column expressions and the scale helpers the operators share."""
