"""Operators for corpora of training texts. Nothing outside this folder imports it, but for the entry's guard."""
