"""Operators for preparing training data: texts, urls, vectors and archives."""
