"""Operators on training data: tokens, pieces, samples, defects, look-alikes, leaks, garble."""
