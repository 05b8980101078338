"""functions of the dialogue engine."""
