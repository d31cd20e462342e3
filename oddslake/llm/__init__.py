"""Operators for building language-model training data; nothing else in oddslake imports them."""
