"""Catalogue search and corpus analytics on Spark."""
