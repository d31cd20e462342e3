"""sources of oddslake."""
