"""Queries over the driver tables, for the check and the bench."""

from .registry import CHECKS, QUERIES
from . import asking, cleaning, documents  # noqa: F401
