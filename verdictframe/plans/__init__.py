"""Query catalogue: importing this package registers every query."""

from verdictframe.plans import (
    agreement, battles, code, enrichment, files, leaderboard, ratings, similarity, streams, text,
    worklist,
)  # noqa: F401
from verdictframe.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
