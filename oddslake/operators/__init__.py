"""operators of oddslake."""
