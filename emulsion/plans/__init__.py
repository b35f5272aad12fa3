"""Registered queries over the driver tables, with the SQL that checks them."""

from . import bindings_camera, bindings_checks  # noqa: F401  (add their queries)
from .bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
