"""The registered queries: each operator on the given tables, with its SQL counterpart."""

from workload import charts, cleaning, edits, profile, recommend, sources, streaming, text
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
