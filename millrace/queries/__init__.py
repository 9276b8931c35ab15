"""The engine's queries, by family."""

from ..registry import QUERIES, SQL
from . import audits, calibration, dedup, imaging, joins, keys, merge, metrics, nested, ranking, reports, rules, sampling, series, sources

__all__ = ["QUERIES", "SQL"]
