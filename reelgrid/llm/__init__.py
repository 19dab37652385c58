"""Operators for language-model data preparation. Nothing outside this folder imports it."""
