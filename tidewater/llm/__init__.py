"""Operators for large training-text corpora; nothing else in tidewater imports this subpackage."""
