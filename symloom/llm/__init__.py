"""Operators for texts of training corpora; nothing outside this subpackage imports it."""
