"""A PySpark engine that inspects, plans and produces bounded-memory thumbnails of PNG images."""

__version__ = "0.1.0"
