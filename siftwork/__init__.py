"""Curation and evaluation of labelled text on Spark."""
