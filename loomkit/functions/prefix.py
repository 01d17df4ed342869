"""Exact global prefix sums without a single-task window.

A window with an ORDER BY and no PARTITION BY runs in one task.  For ranks
over a whole table (AUROC, dense indices) we instead

1. draw a bounded sample of the ordering key and pick range boundaries on the
   driver (about ``40 * buckets`` values travel, whatever the table size);
2. give every row its range bucket with a balanced ``CASE`` tree (log2 depth,
   any orderable type, codegen'd);
3. total each bucket (at most ``buckets`` rows), turn the totals into offsets
   with a window over that tiny frame and broadcast it back (its size is
   bounded by ``buckets``);
4. finish with a window partitioned by bucket.

Input rows must have distinct ordering keys (aggregate first); then no bucket
can hold more than its share of the distinct keys, so a hot key cannot make a
hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.session import written


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return max(1, int(buckets))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(1, parts)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _boundaries(df: DataFrame, key, buckets: int, seed: int = 17) -> list:
    """Sorted, distinct range cut points (tuples) taken from a bounded sample."""
    if buckets <= 1:
        return []
    keys = _keys(key)
    want = 20 * buckets
    n = df.count()
    sample = df.select(*keys)
    if n > want:
        sample = sample.sample(False, min(1.0, 2.0 * want / n), seed)
    vals = sorted(tuple(r) for r in sample.collect()
                  if all(v is not None for v in r))
    if not vals:
        return []
    cuts = []
    for i in range(1, buckets):
        v = vals[min(len(vals) - 1, (i * len(vals)) // buckets)]
        if not cuts or v > cuts[-1]:
            cuts.append(v)
    return cuts


def _less(cols: list[Column], cut: tuple) -> Column:
    """Lexicographic ``cols < cut``."""
    expr = None
    for i in reversed(range(len(cols))):
        lt = cols[i] < F.lit(cut[i])
        expr = lt if expr is None else (lt | ((cols[i] == F.lit(cut[i])) & expr))
    return expr


def bucket_of(col, cuts: list) -> Column:
    """Index of the range ``[cut[i-1], cut[i])`` holding the key (balanced tree).

    ``col`` is a column or a list of columns (lexicographic order); ``cuts``
    are values or tuples."""
    cols = col if isinstance(col, list) else [col]
    tcuts = [c if isinstance(c, tuple) else (c,) for c in cuts]

    def build(lo: int, hi: int) -> Column:
        # buckets lo..hi inclusive; cuts[i] separates bucket i and i+1
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_less(cols, tcuts[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    if not tcuts:
        return F.lit(0)
    return build(0, len(tcuts))


def prefix_sums(df: DataFrame, key, value_cols: list[str],
                prefix: str = "before_", buckets: int | None = None,
                group_cols: list[str] | None = None) -> DataFrame:
    """Add ``<prefix><c>`` = sum of ``c`` over rows of the same group whose
    ``key`` (a column name or a list: lexicographic order) is smaller.

    ``key`` must be unique inside each group.  Exact; no step runs a whole
    group (or the whole table) in one task: the range buckets of ``key`` cut
    every group, the per-(group, bucket) totals are a table of at most
    groups x buckets rows.
    """
    g = list(group_cols or [])
    keys = _keys(key)
    nb = _bucket_count(df, buckets)
    cuts = _boundaries(df, keys, nb)
    tagged = df.withColumn("_bkt", bucket_of([F.col(k) for k in keys], cuts))
    totals = tagged.groupBy(*g, "_bkt").agg(*[F.sum(c).alias(f"_tot_{c}") for c in value_cols])
    w_all = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *g, "_bkt",
        *[F.coalesce(F.sum(f"_tot_{c}").over(w_all), F.lit(0)).alias(f"_off_{c}")
          for c in value_cols])
    w_in = Window.partitionBy(*g, "_bkt").orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, -1)
    # offsets holds at most groups x buckets rows; without groups it is
    # bounded by the bucket count and is broadcast explicitly
    off = F.broadcast(offsets) if not g else offsets
    out = tagged.join(off, [*g, "_bkt"], "left")
    for c in value_cols:
        out = out.withColumn(
            f"{prefix}{c}",
            F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0)))
    return out.drop("_bkt", *[f"_off_{c}" for c in value_cols])


def dense_index(df: DataFrame, key: str, out: str = "idx",
                buckets: int | None = None) -> DataFrame:
    """Distinct non-null ``key`` values with their 0-based sorted position.

    Same result as ``dense_rank() over (order by key) - 1`` without the
    one-task global window.
    """
    # counted, sampled, totalled and ranked below: the distinct keys are computed once
    keys = written(df.select(key).where(F.col(key).isNotNull()).distinct()).withColumn("_one", F.lit(1))
    ranked = prefix_sums(keys, key, ["_one"], prefix="_pos", buckets=buckets)
    return ranked.select(key, F.col("_pos_one").cast("long").alias(out))


def exact_median(df: DataFrame, col: str, buckets: int | None = None):
    """Exact median (mean of the two middle values) without holding the values
    in one task: counts per distinct value, an exact bucketed prefix count,
    then the one or two middle values.  Returns a Python float or None."""
    x = F.col(col).cast("double")
    clean = df.select(x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = clean.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c")).first()[0]
    if not n:
        return None
    lo, hi = (n - 1) // 2, n // 2
    pre = prefix_sums(counts, "v", ["c"], prefix="b_", buckets=buckets)
    hit = pre.where(((F.col("b_c") <= lo) & (F.col("b_c") + F.col("c") > lo))
                    | ((F.col("b_c") <= hi) & (F.col("b_c") + F.col("c") > hi))) \
             .select("v", "b_c", "c").collect()  # at most two rows
    def at(pos):
        return next(r["v"] for r in hit if r["b_c"] <= pos < r["b_c"] + r["c"])
    a, b = at(lo), at(hi)
    return a if a == b else 0.5 * a + 0.5 * b
