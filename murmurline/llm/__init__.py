"""Operators for training data made of text, vectors and scores; nothing else in the library imports them."""
