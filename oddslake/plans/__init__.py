"""plans of oddslake."""
