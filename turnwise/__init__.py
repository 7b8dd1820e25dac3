"""Conversational retrieval analytics on PySpark."""
