"""plans of the dialogue engine."""
