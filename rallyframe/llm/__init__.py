"""Operators for large training-corpus pipelines. Nothing outside this folder imports it."""
