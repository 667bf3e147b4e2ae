"""Deterministic splits, quotas, weights and sampling. Order comes from a hash of the id and a seed, so a row's side does not depend on the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def holdout_split(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """``rows`` with ``split``: max(1, int(n * fraction)) rows of least hash are ``val``, but one at least stays in ``train``.

    Only the n_val-th least hash is found (a bounded top-n merge), then each row compares its own with it: no global sort of the rows.
    """
    total = rows.count()
    n_val = min(max(1, int(total * fraction)), max(0, total - 1))
    keyed = rows.withColumn("__h", order_hash(F.col(key), seed))
    if n_val == 0:
        return keyed.withColumn("split", F.lit("train")).drop("__h")
    buckets = keyed.groupBy(F.substring("__h", 1, 3).alias("b")).count().orderBy("b").collect()
    seen, edge = 0, None
    for row in buckets:
        if seen + row["count"] >= n_val:
            edge = row.b
            break
        seen += row["count"]
    cut = keyed.where(F.substring("__h", 1, 3) == edge).select("__h").orderBy("__h").limit(n_val - seen).agg(F.max("__h").alias("c")).first().c
    return keyed.withColumn("split", F.when(F.col("__h") <= F.lit(cut), "val").otherwise("train")).drop("__h")


def group_split(rows: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """``rows`` with ``split``: whole groups go to ``val`` in order of hash until it has ``fraction`` of the rows; one group at least stays in ``train``."""
    from corpusloom.operators.corpus import running_total

    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__place", hash_place(F.col(group), seed))
    total = sizes.agg(F.sum("n").alias("total"), F.max(F.struct("__place", group)).alias("last")).first()
    if total.total is None:
        return rows.withColumn("split", F.lit("train"))
    target = max(1, int(total.total * fraction))
    placed = running_total(sizes, "__place", F.col("n"), [group])
    is_last = (F.col("__place") == total["last"]["__place"]) & F.col(group).eqNullSafe(F.lit(total["last"][group]))
    chosen = placed.select(F.col(group).alias("__group"), F.when((F.col("__before") < target) & ~is_last, "val").otherwise("train").alias("split"))
    return rows.join(chosen, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def hash_place(key: Column, seed: int) -> Column:
    """The order's hash as a number, for ranges."""
    return F.conv(F.substring(order_hash(key, seed), 1, 14), 16, 10).cast("long")


def example_split(rows: DataFrame, key: str, group: str, fraction: float, seed: int) -> tuple[DataFrame, str]:
    """Chat or preference rows with ``split``, and how: one example is on both sides, groups go whole if every row has one and there are two, else rows go by themselves."""
    n = rows.limit(2).count()
    if n < 2:
        return rows.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("val")))), "single_example"
    row = rows.agg(F.count(F.when(F.coalesce(F.trim(group), F.lit("")) == "", 1)).alias("bare"), F.count_distinct(group).alias("groups")).first()
    if row.bare == 0 and row.groups >= 2:
        return group_split(rows, group, fraction, seed), "group"
    return holdout_split(rows, key, fraction, seed), "random"


def category_weights(rows: DataFrame, category: str, power: float = 1.0) -> DataFrame:
    """``category, n, weight``: 1 / n ** power; balanced at 1, square root at .5."""
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", 1.0 / F.pow(F.col("n").cast("double"), F.lit(power)))


def weighted_sample(rows: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` rows with replacement, by weight: each of ``draws`` uniforms falls in a row's range of cumulated weight.

    Rows and uniforms meet by equal hundredths of the total weight and then by range.
    """
    from corpusloom.operators.corpus import running_total

    cells = 256
    total = rows.agg(F.sum(weight)).first()[0]
    if not total:
        raise ValueError("nothing to draw from")
    named = rows.withColumn("__place", hash_place(F.col(key), seed))
    placed = running_total(named, "__place", F.col(weight).cast("double"), [key]).withColumn("__from", F.col("__before") / F.lit(float(total))).withColumn("__to", F.col("__from") + F.col(weight) / F.lit(float(total))).drop("__before", "__place")
    ranged = placed.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__from") * cells), F.floor(F.least(F.col("__to"), F.lit(0.9999999)) * cells))))
    uniforms = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), (F.conv(F.substring(order_hash(F.col("id"), seed), 1, 12), 16, 10).cast("double") / float(16**12)).alias("u")).withColumn("__cell", F.floor(F.col("u") * cells))
    # the last range takes what rounding leaves above it
    return uniforms.join(ranged, "__cell").where((F.col("u") >= F.col("__from")) & ((F.col("u") < F.col("__to")) | (F.col("__to") > 1 - 1e-12))).drop("__cell", "__from", "__to", "u")


def quota_floor(total: int, weights: dict[str, float]) -> dict[str, int]:
    """int(total * weight), the remainder from left to right."""
    out = {k: int(total * w) for k, w in weights.items()}
    for k in list(out)[: total - sum(out.values())]:
        out[k] += 1
    return out


def quota_largest_remainder(table: DataFrame, total: int) -> DataFrame:
    """``name, weight, quota`` for normalised weights: floors, then one more by largest remainder, ties to the later name."""
    share = table.join(F.broadcast(table.agg(F.sum("weight").alias("__sum")))).withColumn("__exact", F.lit(float(total)) * F.col("weight") / F.col("__sum")).withColumn("__floor", F.floor("__exact"))
    left = share.join(F.broadcast(share.agg((F.lit(total) - F.sum("__floor")).alias("__left"))))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("__exact") - F.col("__floor")), F.desc("name")))
    return left.withColumn("__rank", rank).select("name", "weight", (F.col("__floor") + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0)).cast("long").alias("quota"))


def batches(rows: DataFrame, key: str, seed: int, size: int, ranks: int = 1) -> DataFrame:
    """``key, position, batch, rank``: a permutation of the rows for an epoch (the seed), dealt in batches to ranks; any batch can be found again."""
    from corpusloom.operators.corpus import running_total

    numbered = running_total(rows.select(key).withColumn("__place", hash_place(F.col(key), seed)), "__place", F.lit(1), [key])
    return numbered.select(key, F.col("__before").alias("position"), F.floor(F.col("__before") / size).alias("batch"), (F.floor(F.col("__before") / size) % ranks).alias("rank"))


def rounded_split(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Like ``holdout_split``, with round(n * fraction) rows, at least one on each side."""
    n = rows.count()
    want = max(1, min(n - 1, round(n * fraction))) if n > 1 else 0
    return holdout_split(rows, key, (want + 0.5) / n if n else 0.0, seed)
