"""functions of oddslake."""
