"""Queries by name: a function (spark, sf_dir) and its DuckDB SQL."""

from tidemark.plans import reports, worklists
from tidemark.plans.queries import NAMES

__all__ = ["NAMES", "reports", "worklists"]
