"""Fault rules between nodes: what happens to each message (seq, src, dst).

Rules, as rows (rule, kind, a, b, p, lo, hi), in order: ``partition`` drops messages between a and b in either
direction; ``delay`` delays those from a to b by lo milliseconds, ``random_delay`` by lo to hi - 1; ``drop`` and
``duplicate`` hit those from a to b with probability p. A later delay replaces an earlier one. Chance is a number drawn
from the seed, the rule and the message, so a run can be repeated, whatever tasks it is split into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "rule int, kind string, a long, b long, p double, lo long, hi long"
#: A linear congruential step: multipliers of message and rule, and the modulus.
BY_SEQ, BY_RULE, MODULUS = 1103515245, 12345, 1 << 31


def draw(seed: int) -> Column:
    """A number from 0 to below 1 of each message and rule."""
    mixed = (F.col("seq") % MODULUS * BY_SEQ + F.col("rule") * BY_RULE + F.lit(seed)) % MODULUS
    return mixed / F.lit(float(MODULUS))


def actions(messages: DataFrame, rules: DataFrame, seed: int = 0) -> DataFrame:
    """(seq, dropped, duplicated, delay_ms) of each message; delay_ms is null if it is not delayed."""
    there = (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))
    back = (F.col("kind") == "partition") & (F.col("src") == F.col("b")) & (F.col("dst") == F.col("a"))
    ends = messages.select("src", "dst").distinct().join(rules, there | back)  # few ends, few rules
    hit = messages.join(ends, ["src", "dst"], "left").withColumn("u", draw(seed))
    kind, chance = F.col("kind"), F.col("u") < F.col("p")
    dropped = (kind == "partition") | ((kind == "drop") & chance)
    delay = F.when(kind == "delay", F.col("lo")).when(kind == "random_delay", F.col("lo") + F.floor(F.col("u") * (F.col("hi") - F.col("lo"))).cast("long"))
    return hit.groupBy("seq").agg(
        F.coalesce(F.bool_or(dropped), F.lit(False)).alias("dropped"),
        F.coalesce(F.bool_or((kind == "duplicate") & chance), F.lit(False)).alias("duplicated"),
        F.max(F.when(delay.isNotNull(), F.struct("rule", delay.alias("ms"))))["ms"].alias("delay_ms"),
    )
