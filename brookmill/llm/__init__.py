"""Operators that turn a raw corpus into training data. Nothing outside this folder imports it."""
