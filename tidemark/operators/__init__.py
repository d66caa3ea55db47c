"""Operators over bars, labels and predictions."""
