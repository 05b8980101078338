"""sources of the dialogue engine."""
