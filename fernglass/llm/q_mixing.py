"""Problem 8: documents drawn so that each source has its target share of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.mixing import draw, interleave, plan_mix, shares
from fernglass.llm.tokens import token_table
from fernglass.session import table


def _mix(spark: SparkSession, sf: str):
    tokens = token_table(table(spark, sf, "documents"), "doc_id", "source")
    targets = table(spark, sf, "mix_targets").select("source", "target_share", "max_repeats")
    available = tokens.join(F.broadcast(targets), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    # both sides have one row per source of the fixed target table
    have = {r.source: r.available for r in available.collect()}
    plans = plan_mix(have, {r.source: (r.target_share, r.max_repeats) for r in targets.collect()})
    return tokens, targets, available, plans


def p8_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Every use of a drawn document, in the order of the mix; ``repeats`` counts the document's uses."""
    tokens, _, _, plans = _mix(spark, sf)
    return interleave(draw(tokens, plans), plans).orderBy("slot", "at", "doc_id")


def p8_schedule(spark: SparkSession, sf: str) -> DataFrame:
    tokens, _, _, plans = _mix(spark, sf)
    return interleave(draw(tokens, plans), plans)


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    tokens, targets, available, plans = _mix(spark, sf)
    return shares(draw(tokens, plans), targets, available)


QUERIES = {"p8_drawn": p8_drawn, "p8_schedule": p8_schedule, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
