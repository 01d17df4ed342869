"""Run, metric and registry ledgers as tables: scoping, paging, latest
values, aliases, lineage, blockers, upserts.

All operators are joins, filters and aggregates.  Small literal lookups
(status maps, rename maps) are built from Python dicts, so their size is
bounded by the dict and they can be broadcast.  Joins between ledgers of
unknown size are left to the planner: AQE switches to a broadcast only after
it has measured the side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars

PAGE_DEFAULT = 50
PAGE_MAX = 500

# Tracking-server run state -> platform state.
RUN_STATUS = {
    "SCHEDULED": "queued",
    "RUNNING": "running",
    "FINISHED": "succeeded",
    "FAILED": "failed",
    "KILLED": "cancelled",
}

# Alias precedence when a version carries several.
STAGE_ORDER = ("production", "staging", "archived")

# Artifact classification by lower-cased file name.
#   .pkl/.joblib -> model; .png -> shap / bias / image by name; .json ->
#   selected_hyperparams / input_schema by exact name, else json; .csv -> csv;
#   .log/.jsonl -> logs; anything else -> file (no content type).


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def scope_by_owner(df: DataFrame, owner_col: str, user, is_admin: bool = False) -> DataFrame:
    """Rows the user may see; an admin sees everything."""
    return df if is_admin else df.where(F.col(owner_col) == F.lit(user))


def scope_by_chain(fact: DataFrame, parent: DataFrame, root: DataFrame,
                   fact_key: str, parent_key: str, parent_root_key: str, root_key: str,
                   owner_col: str, user, is_admin: bool = False) -> DataFrame:
    """fact -> parent -> root(owner): inner equi-joins, owner filter pushed to the root.

    The filter is applied to the root before the joins, so only the user's
    root keys travel; the fact table keeps its own columns only.
    """
    r = root.select(root_key, owner_col)
    if not is_admin:
        r = r.where(F.col(owner_col) == F.lit(user))
    p = parent.select(parent_key, parent_root_key).join(
        r.select(F.col(root_key).alias(parent_root_key)), parent_root_key, "left_semi")
    return fact.join(p.select(F.col(parent_key).alias(fact_key)), fact_key, "left_semi")


def list_page(df: DataFrame, order_cols: list[Column], page: int = 1,
              page_size: int = PAGE_DEFAULT) -> DataFrame:
    """Newest-first page plus ``total`` (rows matching before paging).

    A ``page_size`` outside [1, 500] or a page below 1 is an error.  The page is a
    ``TakeOrderedAndProject`` (per-partition top-(offset+limit)); the total is
    a separate one-row count joined as a constant.
    """
    size = int(page_size)
    if not 1 <= size <= PAGE_MAX or int(page) < 1:
        raise ValueError(f"page {page} of {page_size} rows: pages start at 1 and hold 1 to {PAGE_MAX} rows")
    offset = (int(page) - 1) * size
    rows = df.orderBy(*order_cols).offset(offset).limit(size) if offset else \
        df.orderBy(*order_cols).limit(size)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return with_scalars(rows, total)


def find_by_tag(df: DataFrame, tags_col: str, key: str, value: str) -> DataFrame:
    """Rows whose tag map has ``key = value`` (values bound as literals)."""
    return df.where(F.col(tags_col)[F.lit(key)] == F.lit(value))


def run_status_map(status: Column) -> Column:
    """Tracking-server state -> platform state; unknown states lower-cased."""
    return F.coalesce(_lit_map(RUN_STATUS)[status], F.lower(status))


def metric_history(points: DataFrame, runs: DataFrame, run_col: str) -> DataFrame:
    """All points of the given runs (semi-join; the run list can be large)."""
    return points.join(runs.select(run_col), run_col, "left_semi")


def metric_latest(points: DataFrame, key_cols: list[str], order_cols: list[str],
                  value_col: str) -> DataFrame:
    """Last value per key by ``order_cols`` (``max_by``, map-side combined)."""
    ordv = F.struct(*[F.col(c) for c in order_cols])
    return points.groupBy(*key_cols).agg(F.max_by(F.col(value_col), ordv).alias(value_col))


def metric_pivot(points: DataFrame, row_cols: list[str], name_col: str, names: list[str],
                 order_cols: list[str], value_col: str) -> DataFrame:
    """One row per step, one column per metric name (last value by order)."""
    ordv = F.struct(*[F.col(c) for c in order_cols])
    return points.groupBy(*row_cols).pivot(name_col, names).agg(
        F.max_by(F.col(value_col), ordv))


def metric_delta(current: Column, previous: Column, invert: bool = False,
                 epsilon: float = 1e-4) -> tuple[Column, Column]:
    """(relative change, verdict): ``flat`` within the band, ``good``/``bad``."""
    delta = F.try_divide(current - previous, F.abs(previous))
    flat = F.abs(delta) < F.lit(epsilon)
    up = delta > 0
    good = ~up if invert else up
    verdict = F.when(delta.isNull(), F.lit(None)).when(flat, "flat") \
               .when(good, "good").otherwise("bad")
    return delta, verdict


def version_lineage(versions: DataFrame, lookups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left-join every lookup ``(table, key, fact_key)`` onto the versions."""
    out = versions
    for table, key, fact_key in lookups:
        out = out.join(table.withColumnRenamed(key, fact_key), fact_key, "left")
    return out


def alias_resolve(assignments: DataFrame, model: str, alias: str, version: str,
                  assigned_at: str) -> DataFrame:
    """One version per (model, alias): the newest assignment wins (``max_by``)."""
    return assignments.groupBy(model, alias).agg(
        F.max_by(F.col(version), F.struct(F.col(assigned_at), F.col(version))).alias(version),
        F.max(assigned_at).alias(assigned_at))


def aliases_of_versions(resolved: DataFrame, model: str, alias: str, version: str) -> DataFrame:
    """All aliases of each version as a sorted, comma-joined string.

    The set per version is bounded by the number of distinct aliases.
    """
    return resolved.groupBy(model, version).agg(
        F.array_join(F.array_sort(F.collect_set(alias)), ",").alias("aliases"))


def alias_to_stage(aliases: Column) -> Column:
    """production > staging > archived > none (``aliases`` is an array)."""
    e = None
    for s in STAGE_ORDER:
        e = (F.when(F.array_contains(aliases, s), s) if e is None
             else e.when(F.array_contains(aliases, s), s))
    return e.otherwise("none")


def alias_promote(aliases: DataFrame, events: DataFrame, model: str, alias: str,
                  version: str) -> DataFrame:
    """Apply promotion events ``(model, version, stage)`` to the alias table.

    ``production``/``staging`` move that alias to the version; ``archived``
    and ``none`` first clear every alias of the version, ``archived`` then sets
    itself.  One event per (model, version) is expected (the latest).
    """
    ev = events.select(model, version, "stage")
    clears = ev.where(F.col("stage").isin("archived", "none")).select(model, version)
    kept = aliases.join(clears, [model, version], "left_anti")
    sets = ev.where(F.col("stage") != "none").select(model, F.col("stage").alias(alias), version)
    # a newly set alias replaces the old holder of the same (model, alias)
    kept = kept.join(sets.select(model, alias), [model, alias], "left_anti")
    # several events setting the same alias: the highest version wins
    sets = sets.groupBy(model, alias).agg(F.max(version).alias(version))
    return kept.select(model, alias, version).unionByName(sets)


def visible_models(models: DataFrame, versions: DataFrame, model_key: str,
                   owner_col: str, user) -> DataFrame:
    """Models with at least one version owned by the user (semi-join)."""
    owned = versions.where(F.col(owner_col) == F.lit(user)).select(model_key)
    return models.join(owned, model_key, "left_semi")


def versions_desc(versions: DataFrame, model: str, version: str) -> DataFrame:
    """Versions numbered newest first per model (numeric order, not text).

    ``position`` = 1 + number of newer versions of the same model: an exact
    bucketed prefix count, so a model holding a third of all versions is cut
    into ranges instead of sorted in one task (versions are unique per model).
    """
    from loomkit.functions.prefix import prefix_sums

    num = F.col(version).cast("string").try_cast("bigint")
    keyed = versions.withColumn("_neg", -num).withColumn("_one", F.lit(1))
    out = prefix_sums(keyed, "_neg", ["_one"], prefix="_newer", group_cols=[model])
    return out.withColumn("position", F.col("_newer_one") + 1).drop("_neg", "_one", "_newer_one")


def delete_blockers(parents: DataFrame, children: DataFrame, parent_key: str,
                    child_fk: str) -> DataFrame:
    """Per parent: number of referencing children and ``blocked`` flag."""
    n = children.groupBy(F.col(child_fk).alias(parent_key)).agg(
        F.count(F.lit(1)).alias("n_children"))
    out = parents.select(parent_key).join(n, parent_key, "left").fillna({"n_children": 0})
    return out.withColumn("blocked", F.col("n_children") > 0)


def orphan_models(models: DataFrame, versions: DataFrame, model_key: str) -> DataFrame:
    """Models left with no version (anti-join)."""
    return models.join(versions.select(model_key), model_key, "left_anti")


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Merge ``new`` into ``old`` by key; returns (merged table, counts).

    Full outer join on the key; a row is ``updated`` when any column differs
    under null-safe equality, ``created`` when the key is new.
    """
    cols = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_in_old"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_in_new"))
    j = o.join(n, key, "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    in_new = F.col("_in_new").isNotNull()
    existed = F.col("_in_old").isNotNull()
    action = (F.when(in_new & ~existed, "created").when(in_new & ~same, "updated")
               .when(in_new, "unchanged").otherwise("kept"))
    j = j.withColumn("action", action)
    merged = j.select(key, *[F.when(in_new, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
                             for c in cols], "action")
    counts = j.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return merged, counts


def rename_cascade(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Rename values through a small literal map; other values stay."""
    return df.withColumn(col, F.coalesce(_lit_map(mapping)[F.col(col)], F.col(col)))


# Kind and content type by suffix (the longest that fits wins).
ARTIFACT_SUFFIXES = {
    "input_schema.json": ("input_schema", "application/json"),
    "selected_hyperparams.json": ("selected_hyperparams", "application/json"),
    ".csv": ("csv", "text/csv"),
    ".joblib": ("model", "application/octet-stream"),
    ".json": ("json", "application/json"),
    ".jsonl": ("logs", "text/plain"),
    ".log": ("logs", "text/plain"),
    ".pkl": ("model", "application/octet-stream"),
    ".png": ("image", "image/png"),
}
# Images of a report, by a word in their name, first wins.
ARTIFACT_IMAGES = ("shap", "bias")


def classify_artifact(name: Column) -> tuple[Column, Column]:
    """(kind, content_type) from a file base name; a name without a dot in
    front (``input_schema.json``) must match as a whole."""
    low = F.lower(name)
    kind, content = F.lit("file"), F.lit(None).cast("string")
    for suffix in sorted(ARTIFACT_SUFFIXES, key=len):
        k, c = ARTIFACT_SUFFIXES[suffix]
        fits = low.endswith(suffix) if suffix.startswith(".") else low == suffix
        kind, content = F.when(fits, k).otherwise(kind), F.when(fits, c).otherwise(content)
    for word in reversed(ARTIFACT_IMAGES):
        kind = F.when((content == "image/png") & low.contains(word), word).otherwise(kind)
    return kind, content


def file_inventory(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Base name, kind and content type of every listed file path."""
    base = F.regexp_extract(F.col(path_col), r"([^/]*)$", 1)
    kind, ctype = classify_artifact(base)
    return paths.withColumn("name", base).withColumn("kind", kind) \
                .withColumn("content_type", ctype)


def hyperparams_fallback(runs: DataFrame, reports: DataFrame, run_key: str,
                         report_col: str, params_col: str) -> DataFrame:
    """Stored report when present, else the raw run parameters labelled legacy."""
    j = runs.select(run_key, params_col).join(reports.select(run_key, report_col), run_key, "left")
    return j.select(run_key,
                    F.when(F.col(report_col).isNotNull(), "report").otherwise("legacy")
                    .alias("source"),
                    F.coalesce(F.col(report_col), F.col(params_col)).alias("hyperparameters"))


def dashboard_counts(runs: DataFrame, kind_col: str, status_col: str, active: list[str],
                     order_cols: list[str], n_recent: int = 5) -> tuple[DataFrame, DataFrame]:
    """(counts per kind of active rows, the ``n_recent`` newest rows per kind).

    The newest-n filter on ``row_number`` lets Spark keep only n rows per kind
    and map task before the shuffle (``WindowGroupLimit``).
    """
    counts = runs.groupBy(kind_col).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(F.col(status_col).isin(active).cast("long")).alias("n_active"))
    w = Window.partitionBy(kind_col).orderBy(*[F.col(c).desc() for c in order_cols])
    recent = runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_recent)
    return counts, recent


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from Python literals (lookup maps, never data)."""
    return spark.createDataFrame(rows, schema)
