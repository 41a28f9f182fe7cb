"""All registered queries and the SQL that they must agree with."""

from __future__ import annotations

from . import access, conversing, etl, measuring, paying, searching, sourcing, streams, textual  # noqa: F401  each registers its queries
from .registry import ORACLE, QUERIES  # noqa: F401
