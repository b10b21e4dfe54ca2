"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of ``budget`` times all sizes by its weight, at most
``most`` times what it has; the excess is shared anew by weight.  A source's
rate (target over size) is the expected number of copies of each of its
documents.  The whole part is taken outright; the fractional parts are rounded
dependently: two documents exchange mass, weighted by their sizes, until one of
them is a whole number, at odds that keep every expectation.  The words taken
from a source therefore miss its target by less than one document.

The exchanges run as a reduction tree.  A source's documents are dealt by hash
into groups of about ``group_documents``; a group leaves at most one document
undecided; those meet again ``fan_in`` groups at a time until one is left.  A
source that holds most of the rows is so many groups, not one task.  Random
numbers depend on the seed and the documents alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import numbered
from .common import WORD, materialize

NEAR = 1e-9
#: Rows of a table of sources that is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000


def source_targets(sources: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """sources(source, size, ...) with target; sources in code point order, null last, take the weights in turn.

    A source's target is its weight times a common level, at most ``most`` times
    its size.  The level is found by rounds over the table: what passes its
    limit at one level stops there, and the next level shares out the rest.
    """
    ranked = numbered(sources.withColumn("last", F.col("source").isNull()), "last", "source", name="rank").drop("last")
    turn = F.array(*[F.lit(float(w)) for w in weights])[F.pmod("rank", F.lit(len(weights))).cast("int")]
    ranked = materialize(ranked.withColumns({"weight": turn, "limit": F.col("size") * F.lit(float(most))}).drop("rank"), "mix-sources")
    level, stopped = float("-inf"), -1
    while True:
        over = F.col("limit") < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum("size").alias("all"), F.count_if(over).alias("stopped"), F.sum(F.when(over, F.col("limit"))).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row["stopped"] == stopped or not row["open"]:
            break
        stopped, level = row["stopped"], (budget * (row["all"] or 0) - (row["used"] or 0.0)) / row["open"]
    return ranked.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).drop("weight", "limit")


def pivot(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the exchanges: all 0 or 1, but for one at most."""
    p = p.astype(float).copy()
    held = -1
    for k in range(len(p)):
        if not NEAR < p[k] < 1 - NEAR:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = held, k
        sa, sb = float(size[a]), float(size[b])
        up = min((1 - p[a]) * sa, p[b] * sb)  # mass that can go from b to a
        down = min(p[a] * sa, (1 - p[b]) * sb)
        move = up if draws[k] * (up + down) < down else -down
        p[a] += move / sa
        p[b] -= move / sb
        for i in (a, b):
            if p[i] < NEAR or p[i] > 1 - NEAR:
                p[i] = round(p[i])
        held = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return p


def _draws(keys: list, seed: int, level: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{level}:{k}".encode()) / 2.0**64 for k in keys])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0, seed: int = 0, group_documents: int = 4096, fan_in: int = 64) -> DataFrame:
    """How many words the mix takes of each document.

    docs: doc_id, text, source; further columns are ignored.  Size is the number
    of words (null text: 0); a document of size 0 is taken 0 times over.  A null
    source is a source like any other.  Repeated rows are decided each by
    itself, and dealt to many groups however many they are.  Returns doc_id,
    source, size, source_size, target, copies, taken; an empty table gives an
    empty result.

    The table of sources may be of any length: nothing of it comes to the
    driver but sums, and it is broadcast up to BROADCAST_SOURCES rows only.
    """
    sized = docs.select(F.col("doc_id").cast("string"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sized = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.sum("rows").alias("n"))
    targets = source_targets(sources, weights, budget, most)
    plan = targets.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate"), F.ceil(F.col("n") / group_documents).cast("bigint").alias("groups"))
    plan = materialize(plan, "mix-plan")
    about = plan.agg(F.count("*").alias("sources"), F.max("groups").alias("groups")).first()
    plan_here = F.broadcast(plan) if about["sources"] <= BROADCAST_SOURCES else plan
    rows = sized.join(plan_here, sized["source"].eqNullSafe(F.col("of"))).drop("of")
    # Repeated rows one by one again, a thousand at a time.
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / 1000))))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("rows"), (F.col("part") + 1) * 1000) - 1))).drop("rows", "part")
    rows = rows.withColumns({"base": F.floor("rate").cast("bigint"), "p": F.col("rate") - F.floor("rate")})
    moving = (F.col("size") > 0) & (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
    kept = ["doc_id", "source", "size", "source_size", "target", "base", "p", "groups"]
    still = rows.where(~moving).select(*kept).withColumn("p", F.round("p"))
    groups = F.pmod(F.xxhash64("doc_id", "source", "size", "nth", F.lit(seed)), F.col("groups"))
    open_rows = rows.where(moving).select(*kept, groups.alias("grp"))
    done: list[DataFrame] = [still]
    schema = open_rows.schema
    level, most_groups = 0, about["groups"] or 1

    def decider(level: int):
        def decide(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["size", "doc_id", "p"], ascending=[False, True, True], kind="stable")  # the small come last: what is left over is small
            keys = [f"{d}:{k}" for k, d in enumerate(part["doc_id"])]
            p = pivot(part["size"].to_numpy(), part["p"].to_numpy(), _draws(keys, seed, level))
            return part.assign(p=p)

        return decide

    whole = (F.col("p") <= 0) | (F.col("p") >= 1)
    while True:
        out = materialize(open_rows.groupBy("source", "grp").applyInPandas(decider(level), schema), f"mix-level{level}")
        done.append(out.where(whole).drop("grp"))
        open_rows = out.where(~whole).withColumn("grp", F.floor(F.col("grp") / fan_in).cast("bigint"))
        if most_groups <= 1:
            break
        most_groups, level = -(-most_groups // fan_in), level + 1
    last = open_rows.withColumn("p", (F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("last")), F.lit(1 << 30)) / F.lit(1 << 30) < F.col("p")).cast("double"))
    done.append(last.drop("grp"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.when(F.col("size") > 0, F.col("p").cast("bigint")).otherwise(0)).cast("bigint")
    return out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0))).select(F.col("doc_id").cast("bigint"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
