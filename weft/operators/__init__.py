"""Operators over relations (i, j, w), profiles (node, dim, w), pairs, neighbours and predictions."""
