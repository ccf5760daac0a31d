"""Operators for training-data text and entity problems. Nothing outside this subpackage imports it."""
