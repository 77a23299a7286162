"""Operators that prepare training data at scale."""
