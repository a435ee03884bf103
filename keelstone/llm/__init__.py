"""Operators for preparing a language-model training corpus."""
