"""User-supplied scorers: whatever gives a table of scores can feed the audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DIMENSIONS
from .verdict import clamp01

_SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_scorer(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """``fn`` maps claims to (document_id, claim_id, dimension, score, confidence); it may use mapInPandas inside."""
    _SCORERS[name] = fn


def score_with(name: str, claims: DataFrame) -> DataFrame:
    """Scores of a registered scorer, kept to the contract: known dimensions and claims, numbers in [0, 1]."""
    got = _SCORERS[name](claims).where(F.col("dimension").isin(*DIMENSIONS))
    known = got.join(claims.select("document_id", "claim_id").distinct(), ["document_id", "claim_id"], "left_semi")
    return known.select("document_id", "claim_id", "dimension", clamp01(F.col("score")).alias("score"), clamp01(F.col("confidence")).alias("confidence"))
