"""Operators on corpora and terms for training data.  Nothing outside this folder imports it."""
