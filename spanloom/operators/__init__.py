"""operators of the dialogue engine."""
