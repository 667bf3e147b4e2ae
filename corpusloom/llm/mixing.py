"""Mixing sources to target weights by entropy balancing.

Tokens of each source must meet a target. Among all document rates that do, entropy balancing takes those of least
relative entropy, weighted by size, to the corpus as it is: ``rate = exp(lambda of the source)``, an exponential tilt. The multipliers
solve the convex dual ``sum_s S_s exp(lambda_s) - lambda_s T_s`` by Newton iterations. The constraints of different
sources share no document, so the Hessian is diagonal: documents are pre-aggregated to one row for each source, and
each source's iterations run where that row is, and a row that hasn't converged stops the query. Nothing but one row of totals reaches
the driver. ``balanced`` solves the same dual where constraints overlap (sources and languages, say): documents are summed to cells of
equal values, each Newton step sums moments and cross moments of the cells over the cluster, and the driver solves for the multipliers.

Targets share all words by weights 1, 2, 3, repeating over the sources by code point, null last; a target stops at 3
times its source's size and the excess is shared again by weight until none is above. The rank of a source comes from a
range sort with counts for each partition, so any number of sources works.

Rates become copies by systematic rounding: a source's documents, in buckets of about ``BUCKET_ROWS`` rows chosen by a hash
of the id and the text, from the longest to the shortest, get ``floor(i * rate + u) - floor((i - 1) * rate + u)`` copies at place i, which is
the rate rounded down or up and never above 3. The starts u of a source's buckets are spread evenly over 0 to 1, so that what one bucket
rounds up another rounds down at the same place, and neighbours have nearly the same size: the words taken stay near the
target. A hot source has many buckets, so no task holds all of it.

Defined results: a null text has size 0; null is a source of its own, last; equal rows are told apart by place, and
which of two rows alike in id and size gets a copy more is the same for the result's rows; an empty table gives no rows; sources of size 0
have target 0 and nothing taken; texts of any length are counted whole. Other columns are ignored by ``plan``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

MOST = 3
WEIGHTS = 3
BUCKET_ROWS = 4_000
NEWTON_STEPS = 80
WORDS = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` (one row for each) with ``rank`` from 0 by code point, null last; counts of partitions are the only thing collected."""
    keyed = sources.withColumn("__null", F.col("source").isNull()).withColumn("__key", F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    order = [F.col("__null"), F.col("__key")]
    placed = stored(keyed.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "sources")
    counts = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    start = F.lit(0)
    for part, offset in offsets:
        start = F.when(F.col("__part") == part, F.lit(offset)).otherwise(start) if len(offsets) <= 64 else start
    if len(offsets) > 64:
        table = placed.sparkSession.createDataFrame(offsets, "__part int, __offset long")
        placed, start = placed.join(F.broadcast(table), "__part"), F.col("__offset")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.withColumn("rank", (place + start).cast("long")).drop("__part", "__null", "__key", "__offset")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``weight`` and ``target``; one row of totals is collected in each round."""
    weighted = stored(ranked_sources(sources).withColumn("weight", (F.col("rank") % WEIGHTS + 1).cast("long")).drop("rank"), "weights")
    total = weighted.agg(F.sum("source_size").alias("n")).first().n or 0
    level: tuple[int, int] | None = None
    capped = F.lit(False)
    while True:
        # a source once capped stays so: the level only rises
        row = weighted.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)).alias("full"), F.count(F.when(capped, 1)).alias("n")).first()
        if row is None or not row.w:
            break
        now = (total - row.full, row.w)
        if now == level:
            break
        level = now
        capped = F.col("weight").cast("double") * F.lit(float(level[0])) / F.lit(float(level[1])) > most * F.col("source_size")
    share = F.col("weight").cast("double") * F.lit(float(level[0])) / F.lit(float(level[1])) if level else F.lit(0.0)
    return weighted.withColumn("target", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share))


def tilt(size: Column, target: Column) -> Column:
    """Rate exp(lambda) of a source by Newton steps on its part of the dual; 0 where there is nothing to take; an error if the constraint isn't met."""
    step = lambda x, _: x + target / (size * F.exp(x)) - 1
    solved = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step))
    met = F.abs(size * solved - target) <= 1e-9 * target
    checked = F.when(met, solved).otherwise(F.raise_error(F.lit("a source's rate has not converged")).cast("double"))
    return F.when((size > 0) & (target > 0), checked).otherwise(F.lit(0.0))


#: Constraints that ``balanced`` takes, at most; their cross moments are a table of this many rows and columns.
MOST_CONSTRAINTS = 1_000


def balanced(docs: DataFrame, targets: dict[str, dict], size_col: str = "size", steps: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """``docs`` with ``rate``: of all rates by which every value of some columns gets its target of ``size_col``, those of least relative entropy.

    ``targets`` has the target of each value of each column; rows of a value without one keep a factor of 1 for that column. The targets of the
    columns must agree in their sums; a mix that can't be reached, or isn't within ``steps`` Newton steps, is an error.
    """
    names = [(c, v) for c, wanted in targets.items() for v in wanted]
    if len(names) > MOST_CONSTRAINTS:
        raise ValueError(f"more than {MOST_CONSTRAINTS} constraints")
    columns = list(targets)
    place = {n: i for i, n in enumerate(names)}
    wanted = np.array([targets[c][v] for c, v in names], float)
    cells = stored(docs.groupBy(*columns).agg(F.sum(F.col(size_col).cast("double")).alias("__size")), "cells")

    def factor(x: np.ndarray) -> Column:
        out = F.lit(0.0)
        for c in columns:
            known = [(v, float(x[place[c, v]])) for v in targets[c]]
            table = F.create_map(*[F.lit(y) for pair in known if pair[0] is not None for y in pair]) if any(v is not None for v, _ in known) else None
            own = F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0)) if table is not None else F.lit(0.0)
            null = next((y for v, y in known if v is None), 0.0)
            out = out + F.when(F.col(c).isNull(), F.lit(null)).otherwise(own)
        return F.exp(out)

    def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weighted = cells.withColumn("__mass", F.col("__size") * factor(x))
        first, second = np.zeros(len(names)), np.zeros((len(names), len(names)))
        for i, a in enumerate(columns):
            for b in columns[i:]:
                for row in weighted.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum("__mass").alias("m")).collect():
                    p, q = place.get((a, row.a)), place.get((b, row.b))
                    if p is not None and a == b:
                        first[p] = second[p, p] = row.m
                    elif p is not None and q is not None:
                        second[p, q] = second[q, p] = row.m
        return first, second

    x = np.zeros(len(names))
    for _ in range(steps):
        first, second = moments(x)
        if np.abs(first - wanted).max(initial=0.0) <= tolerance * max(1.0, wanted.max(initial=0.0)):
            return docs.withColumn("rate", factor(x))
        move = np.linalg.lstsq(second + 1e-12 * np.trace(second) * np.eye(len(names)), wanted - first, rcond=None)[0]
        x = x + move * min(1.0, 1.0 / max(1e-12, np.abs(move).max()))
    raise ValueError("the targets can't be reached together")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """``doc_id, size, source, source_size, target, rate, copies, taken`` for every row of ``docs``."""
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("own")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    solved = targets(per_source, most).withColumn("rate", F.least(F.lit(float(most)), tilt(F.col("source_size").cast("double"), F.col("target"))))
    solved = stored(solved.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS)), "rates")
    joined = sized.withColumnRenamed("source", "__source").join(solved, F.col("__source").eqNullSafe(F.col("source"))).drop("__source")
    bucketed = joined.withColumn("bucket", F.pmod(F.xxhash64("own"), F.col("buckets")))
    place = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(F.desc("size"), "own", "doc_id"))
    start = (F.col("bucket") + 0.5) / F.col("buckets")
    rounded = F.floor(place * F.col("rate") + start) - F.floor((place - 1) * F.col("rate") + start)
    copies = F.least(F.lit(most), F.greatest(F.lit(0), rounded)).cast("int")
    return bucketed.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
