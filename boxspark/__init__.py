"""Spark jobs for object-detection datasets and detector results, and for text corpora."""
