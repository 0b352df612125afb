"""Corvane: program-corpus analytics on PySpark."""
