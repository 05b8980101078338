"""streaming of the dialogue engine."""
