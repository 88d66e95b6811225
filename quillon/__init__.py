"""Quillon: data-integrity screening and data-processing operators as Spark plans."""
