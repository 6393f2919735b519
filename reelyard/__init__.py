"""Spark jobs over fleets of media-optimisation work: catalogs, encode attempts,
quality scores, progress events, probe documents and benchmark logs."""

__version__ = "0.1.0"
