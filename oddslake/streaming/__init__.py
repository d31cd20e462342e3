"""streaming of oddslake."""
