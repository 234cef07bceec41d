"""Brute-force helpers the tests of this folder share."""

from test_operators import brute_components, low

__all__ = ["brute_components", "low"]
