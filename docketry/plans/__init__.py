"""Registered queries and their SQL forms."""

from . import catalog, citations, evidence, fixed, indexed, lifecycle, pages, quality, reviewing  # noqa: F401
