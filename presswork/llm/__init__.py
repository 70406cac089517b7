"""Operators for large text corpora (problems 2 to 10). Nothing outside this subpackage imports it."""
