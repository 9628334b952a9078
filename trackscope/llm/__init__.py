"""Operators on training and evaluation records. Nothing outside this subpackage imports it."""
