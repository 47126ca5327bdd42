"""Ranking, sampling, paging and latest-row operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN1-3/JON21: the row with the greatest ``order`` of each key.

    ``max_by`` aggregates partially before the shuffle, so a key with very many
    rows is one row a map task; a window would gather them all.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SET2/AGG27: the row with the least ``order`` of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


last_wins = latest_per_key  # SET1


def descending(text: Column) -> Column:
    """A text whose order is the reverse of the given one's, for orders that mix both."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


#: Sampled rows for each cut between ranges.
SAMPLED = 50


def _bounds(df: DataFrame, order: list[str], parts: int) -> Column:
    """The range that a row falls in, by cuts of the whole order: a frequent first value is cut by the columns after it."""
    kinds = dict(df.dtypes)
    some = df.select(*order).orderBy(F.rand(7)).limit(SAMPLED * parts)
    cuts = list(dict.fromkeys(tuple(r) for r in some.orderBy(*order).collect()[SAMPLED::SAMPLED]))
    if not cuts:
        return F.lit(0)
    row = F.struct(*order)
    cut = lambda values: F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, values)))
    return F.size(F.filter(F.array(*map(cut, cuts)), lambda c: c < row))


def running(df: DataFrame, order: list[str], value: Column | None = None) -> DataFrame:
    """WIN5/7/9: row number ``rank`` (from 1) and, with ``value``, the sum ``before`` each row, in total order.

    Rows are dealt by ranges of the order and numbered within their range; the ranges' own
    counts and sums (one row each) are added up and joined back, so no single task sees all
    rows, unless all agree in every column of the order. Nulls come first.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    amount = F.lit(0).cast("double") if value is None else value
    # Which partition a row is in must not change between the two uses: bounds are computed once and are plain values then.
    bounds = _bounds(df, order, parts)
    dealt = df.withColumn("_v", amount).withColumn("_part", bounds)
    inside = Window.partitionBy("_part").orderBy(*order)
    own = dealt.withColumn("_r", F.row_number().over(inside)).withColumn("_b", F.coalesce(F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_on"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_os"))
    out = own.join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("_r") + F.col("_on")).cast("long"))
    if value is not None:
        out = out.withColumn("before", F.col("_b") + F.col("_os"))
    return out.drop("_v", "_part", "_r", "_b", "_on", "_os")


def hash_ranked_split(df: DataFrame, id_col: str, n: int, ratio: float = 0.8, select_salt: str = "select:", split_salt: str = "split:") -> DataFrame:
    """SRT1: the ``n`` rows with the least hash; of these the least second hashes are DIAGNOSTIC.

    Both limits are top-k: each task keeps ``n`` rows at most. ``n`` is the feature's size.
    """
    ident = F.col(id_col).cast("string")
    chosen = df.withColumn("_h", F.sha2(F.concat(F.lit(select_salt), ident), 256)).orderBy("_h", id_col).limit(n).drop("_h")
    second = chosen.withColumn("_s", F.sha2(F.concat(F.lit(split_salt), ident), 256))
    ranked = second.withColumn("_k", F.row_number().over(Window.orderBy("_s", id_col))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return ranked.withColumn("split", F.when(F.col("_k") <= F.round(F.col("_n") * F.lit(ratio)), "DIAGNOSTIC").otherwise("LOCKED_HOLDOUT")).drop("_s", "_k", "_n")


def sample_per_pool(df: DataFrame, pool: str, id_col: str, n: int, salt: str = "") -> DataFrame:
    """SRT3/4: ``n`` rows of each pool by least hash; partial lists of ``n`` before the shuffle."""
    hashed = df.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256))
    window = Window.partitionBy(pool).orderBy("_h", id_col)
    # A row_number filter is pushed into a per-task group limit by the optimiser.
    return hashed.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n).drop("_h")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """SRT5: the first ``n`` rows, ranked."""
    some = df.orderBy(*order).limit(n)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SRT8: pages 1-400 of 1-100 rows."""
    if not (1 <= number <= 400 and 1 <= size <= 100):
        raise ValueError("page must be 1-400 and its size 1-100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_any(columns: list[str], query: str | None) -> Column:
    """FLT7/8: literal, case-insensitive; no query lets all rows pass."""
    if not query:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return hit


def in_or_not(column: str, values: list, inverted: bool = False) -> Column:
    """FLT9"""
    return ~F.col(column).isin(values) if inverted else F.col(column).isin(values)


def select_until(df: DataFrame, order: list[str], value: Column, goal: float) -> DataFrame:
    """WIN9: whole rows until the running sum reaches ``goal``."""
    return running(df, order, value).where(F.col("before") < goal)


def batches(df: DataFrame, order: list[str], size: int = 40) -> DataFrame:
    """SRT10: consecutive batches of ``size`` rows."""
    return running(df, order).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long"))


def with_share(counts: DataFrame, value: str) -> DataFrame:
    """WIN10: share of the total; meant for already aggregated rows."""
    total = counts.agg(F.sum(value).alias("_t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("_t") > 0, F.col(value) / F.col("_t")).otherwise(F.lit(0.0))).drop("_t")


def occurrence_ids(df: DataFrame, fingerprint: str, order: list[str]) -> DataFrame:
    """HSH4/WIN6: ``record:<fingerprint>:<n>`` in row order.

    Each fingerprint's rows are numbered by ranges of the order, so a hot one is many tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.withColumn("_part", _bounds(df, order, parts))
    own = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(fingerprint, "_part").orderBy(*order)))
    earlier = Window.partitionBy(fingerprint).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(fingerprint, "_part").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    both = own.alias("a").join(offsets.alias("b"), F.col(f"a.{fingerprint}").eqNullSafe(F.col(f"b.{fingerprint}")) & (F.col("a._part") == F.col("b._part")))
    n = (F.col("_r") + F.col("_o")).cast("string")
    return both.select("a.*", F.concat(F.lit("record:"), F.col(f"a.{fingerprint}"), F.lit(":"), n).alias("record_id")).drop("_part", "_r")
