"""Registered queries."""

from . import registry  # noqa: F401  (first, so that the query modules register themselves in one order)
