"""Conversions from end to end, and every operator as a query."""

from . import format_queries as format_queries
