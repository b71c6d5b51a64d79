"""The pin ledger: adding, claiming and releasing pins against the revision that the caller has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _step(now: Column, op: Column) -> Column:
    """One operation: it applies if the expected revision, where one is named, is the present one, and the state fits."""
    seen = op["expected"].isNull() | (op["expected"] == now["revision"])
    fits = F.when(op["op"] == "add", now["state"] == "free").when(op["op"] == "claim", now["state"] == "held").otherwise(now["state"] != "free")
    ok = seen & fits
    state = F.when(~ok, now["state"]).when(op["op"] == "add", "held").when(op["op"] == "claim", "claimed").otherwise("free")
    return F.struct((now["revision"] + ok.cast("long")).alias("revision"), state.alias("state"), (now["refused"] + (~ok).cast("long")).alias("refused"))


def ledger(ops: DataFrame) -> DataFrame:
    """(token, revision, state, refused) after ops (token, at, op, expected) in order of at.

    op is add (a free pin becomes held), claim (held becomes claimed) or release (becomes free); expected is the
    revision that the caller has seen, or null for any. An operation whose revision is stale or whose state does not fit
    is refused and changes nothing; every other raises the revision. Whether one applies depends on all before it, so
    the history of one token is folded in one place; tokens are independent.
    """
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.lit("free").alias("state"), F.lit(0).cast("long").alias("refused"))
    history = ops.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("at", "op", F.col("expected").cast("long").alias("expected")))).alias("ops"))
    folded = history.select("token", F.aggregate("ops", start, _step).alias("s"))
    return folded.select("token", "s.revision", "s.state", "s.refused")
