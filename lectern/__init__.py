"""Lectern: document analytics and evidence retrieval as Spark DataFrame operators."""
