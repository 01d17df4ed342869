"""Small expression builders.

Everything here returns a ``Column`` made of built-in functions, so it stays
inside whole-stage codegen and is the same expression DuckDB can evaluate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_unit(seed: int, *keys) -> Column:
    """Deterministic uniform number in [0, 1) from ``seed`` and a row key.

    ``u = int(first 8 hex digits of md5('<seed>:<key>')) / 2^32``.  Composite
    keys are joined with ``|``.  Order-free and stable under repartitioning;
    DuckDB computes the same value with
    ``('0x' || substr(md5('<seed>:' || key), 1, 8))::bigint / 4294967296.0``.
    Keys should be integers or strings (double-to-string differs by engine).
    """
    parts = [_as_col(k).cast("string") for k in keys]
    key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_32)


def split_bucket(u: Column, fractions: list[float], names: list[str]) -> Column:
    """Map a uniform number to the name of the cumulative-fraction bucket."""
    total = float(sum(fractions))
    if total <= 0:
        raise ValueError("split fractions sum to zero or less")
    expr = None
    cum = 0.0
    for frac, name in zip(fractions[:-1], names[:-1]):
        cum += frac / total
        expr = (F.when(u < F.lit(cum), F.lit(name)) if expr is None
                else expr.when(u < F.lit(cum), F.lit(name)))
    last = F.lit(names[-1])
    return last if expr is None else expr.otherwise(last)


def r6(c, digits: int = 6) -> Column:
    """Round half away from zero as ``round(x * 10^d) / 10^d``.

    This is the exact formula DuckDB's ``round(x, d)`` evaluates, so a value
    computed identically in both engines rounds identically, even at a tie.
    """
    m = float(10 ** digits)
    return F.round(_as_col(c).cast("double") * F.lit(m)) / F.lit(m)


def safe_div(num, den) -> Column:
    """NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(_as_col(num), _as_col(den))


def slugify(c) -> Column:
    """Lower-cased and stripped; every char that is not a letter, digit, ``-``
    or ``_`` becomes ``-``; leading/trailing ``-`` removed; empty -> ``model``."""
    low = F.lower(F.trim(_as_col(c)))
    dashed = F.regexp_replace(low, r"[^\p{L}\p{N}_-]", "-")
    stripped = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(stripped == "", F.lit("model")).otherwise(stripped)


def with_scalars(df, one_row, prefix: str = ""):
    """Attach the values of a one-row aggregate frame to every row of ``df``
    as typed literals (no join).  The aggregate is evaluated once; a frame
    with more than one row is an error."""
    import datetime as _dt

    rows = one_row.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("with_scalars expects a one-row frame")
    out = df
    for field in one_row.schema.fields:
        v = rows[0][field.name] if rows else None
        if isinstance(v, (_dt.datetime, _dt.date)):
            lit = F.lit(v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat())
        else:
            lit = F.lit(v)
        out = out.withColumn(prefix + field.name, lit.cast(field.dataType))
    return out


def epoch_seconds(c) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock timestamp, independent
    of the session time zone (``TIMESTAMP_NTZ`` arithmetic)."""
    ts = _as_col(c).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
