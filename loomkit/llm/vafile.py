"""Exact inner-product top-k by a vector-approximation file.

Every vector is stored twice: exactly, and as one small cell number per
component.  A scan of the cells gives a lower and an upper bound of each inner
product; the k-th largest lower bound rules most vectors out.  The exact
vectors of the rest are read in order of their upper bounds, first the k best,
then those whose bound still reaches the k-th exact score, until no unread
vector can enter the result.

Equal vectors form one class: cells are scanned and vectors read once per
class, and a class names at most its k + 1 smallest ids, since no query can
report more of it.  A vector that a third of the rows repeat costs no more than
any other.

Queries and vectors meet in blocks of bounded size (every query block against
every cell block), joined on the pair of block numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.llm.common import materialise

QUERY_BLOCK, CELL_BLOCK, BITS, SALTS = 4096, 8192, 6, 32


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, x in zip(pdf["id"], pdf["x"]):
            v = np.asarray(x, np.int64)
            if len(v) and np.abs(v).max() >= 2**31:
                raise ValueError(f"vector {i}: a scaled component needs more than 32 bits")
            rows.append((i, len(v), v.astype("<i4").tobytes()))
        yield pd.DataFrame(rows, columns=["id", "dim", "vec"])


def scaled_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """``(id, dim, vec)`` with components ``floor(scale * x)``; vectors that are
    null or hold null or non-finite components are left out, as are null ids."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok) \
        .select(F.col(id_col).cast("long").alias("id"), ints.alias("x")) \
        .mapInPandas(_packed, "id long, dim int, vec binary")


def _extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for dim, vecs in pdf.groupby("dim")["vec"]:
            m = np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), dim).astype(np.int64)
            lo, hi = m.min(axis=0, initial=2**31), m.max(axis=0, initial=-2**31)
            old = seen.get(dim, (lo, hi))
            seen[dim] = np.minimum(lo, old[0]), np.maximum(hi, old[1])
    for dim, (lo, hi) in seen.items():
        yield pd.DataFrame({"dim": [dim], "lo": [lo], "hi": [hi]})


def cell_edges(vectors: DataFrame, bits: int = BITS) -> dict[int, np.ndarray]:
    """Per dimension count: ``2**bits + 1`` edges of every component's cells.

    Cells have equal width between the smallest and largest value found over
    all vectors; one pair of rows per task travels to the driver."""
    got: dict[int, tuple] = {}
    for r in vectors.select("dim", "vec").mapInPandas(_extent, "dim int, lo array<long>, hi array<long>").collect():
        lo, hi = np.array(r["lo"], np.int64), np.array(r["hi"], np.int64)
        old = got.get(r["dim"], (lo, hi))
        got[r["dim"]] = np.minimum(lo, old[0]), np.maximum(hi, old[1])
    step = np.arange(2**bits + 1, dtype=np.int64)[:, None]
    return {d: lo + step * (hi - lo + 1) // 2**bits for d, (lo, hi) in got.items()}


def _to_cells(edges: dict[int, np.ndarray]):
    """Cell numbers of whole batches: component by component."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                m = np.frombuffer(b"".join(part["vec"]), "<i4").reshape(len(part), dim)
                c = np.empty((len(part), dim), np.uint8)
                for j in range(dim):
                    c[:, j] = np.searchsorted(edges[dim][1:, j], m[:, j], side="right")
                yield part[["cid", "dim", "db"]].assign(cells=[x.tobytes() for x in c])
    return run


def bounds(q: np.ndarray, cells: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of integer queries with the
    vectors of the given cells."""
    at = np.arange(cells.shape[1])
    low, high = edges[cells, at], edges[cells.astype(np.int64) + 1, at] - 1
    most = int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * int(np.abs(q).max(initial=0))
    kind = np.float64 if most * max(1, q.shape[1]) < 2**53 else np.int64  # exact either way
    pos, neg = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    low, high = low.T.astype(kind), high.T.astype(kind)
    return pos @ low + neg @ high, pos @ high + neg @ low


def _candidates(edges: dict[int, np.ndarray], want: int):
    def run(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(cells):
            dim = int(cells["dim"].iloc[0])
            c = np.frombuffer(b"".join(cells["cells"]), np.uint8).reshape(len(cells), dim)
            cid = cells["cid"].to_numpy(np.int64)
            for lo in range(0, len(queries), 256):
                part = queries.iloc[lo:lo + 256]
                q = np.frombuffer(b"".join(part["vec"]), "<i4").reshape(len(part), dim).astype(np.int64)
                lb, ub = bounds(q, c, edges[dim])
                if len(c) > want:
                    kth = np.partition(lb, len(c) - want, axis=1)[:, len(c) - want]
                    r, s = np.nonzero(ub >= kth[:, None])
                else:
                    r, s = (x.ravel() for x in np.indices(lb.shape))
                out.append(pd.DataFrame({"qid": part["qid"].to_numpy(np.int64)[r], "cid": cid[s],
                                         "lb": lb[r, s].astype(np.int64), "ub": ub[r, s].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "cid": [], "lb": [], "ub": []}, dtype="int64")
    return run


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        s = [int(np.frombuffer(a, "<i4").astype(np.int64) @ np.frombuffer(b, "<i4").astype(np.int64))
             for a, b in zip(pdf["qvec"], pdf["vec"])]
        yield pd.DataFrame({"qid": pdf["qid"], "cid": pdf["cid"], "score": s})


def _read_exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    near = pairs.select("qid", "cid").join(vectors, "cid").join(
        queries.select("qid", F.col("vec").alias("qvec")), "qid")
    return near.select("qid", "cid", "qvec", "vec").mapInPandas(_scores, "qid long, cid long, score long")


def _block(col: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int")


def exact_top_k(df: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id",
                vec_col: str = "embedding", scale: float = 64.0, bits: int = BITS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner
    products of every query row with all rows but its own, ties to the smaller
    id; fewer where there are fewer rows.

    ``is_query`` maps the id to the condition that marks a query.  Vectors that are null, or
    hold null or non-finite components, and null ids take no part; vectors meet
    those of their own length only.  Ids are unique: of rows that repeat one,
    the vector that sorts first counts.  Scaled components must fit 32 bits and
    scores 64.  An empty table gives no rows; other columns are ignored.
    """
    want = k + 1  # the query's own row may be among them
    flags = df.select(F.col(id_col).cast("long").alias(id_col), vec_col)
    rows = materialise(scaled_vectors(flags, id_col, vec_col, scale)
                       .groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("id", "v.*"), "vectors")
    by_salt = Window.partitionBy("vec", "salt").orderBy("id")
    by_vec = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))) \
        .withColumn("_n", F.row_number().over(by_salt)).where(F.col("_n") <= want) \
        .withColumn("_n", F.row_number().over(by_vec)).where(F.col("_n") <= want)
    classes = materialise(few.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                          .select(F.col("ids")[0].alias("cid"), "dim", "vec", "ids"), "classes")
    asked = rows.where(is_query(F.col("id"))).select("vec", F.col("id").alias("query_id"))
    query_ids = materialise(asked.join(classes.select("vec", F.col("cid").alias("qid")), "vec")
                            .select("qid", "query_id"), "queries")
    queries = materialise(query_ids.select("qid").distinct().join(
        classes.select(F.col("cid").alias("qid"), "dim", "vec"), "qid"), "query_vectors")

    edges = cell_edges(classes, bits)
    n_cells, n_queries = classes.count(), queries.count()
    db, qb = max(1, math.ceil(n_cells / CELL_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = classes.withColumn("db", _block("cid", db)).select("cid", "dim", "db", "vec") \
        .mapInPandas(_to_cells(edges), "cid long, dim int, db int, cells binary").withColumn("qb", every(qb))
    blocks = queries.withColumn("qb", _block("qid", qb)).withColumn("db", every(db))
    found = blocks.groupBy("dim", "qb", "db").cogroup(cells.groupBy("dim", "qb", "db")) \
        .applyInPandas(_candidates(edges, want), "qid long, cid long, lb long, ub long")
    found = materialise(found, "candidates")

    # the k-th lower bound over all blocks, then the best of what it leaves
    by_lb = Window.partitionBy("qid").orderBy(F.desc("lb"))
    reach = found.withColumn("_n", F.row_number().over(by_lb)).where(F.col("_n") <= want) \
        .groupBy("qid").agg(F.when(F.count(F.lit(1)) == want, F.min("lb")).alias("floor"))
    by_ub = Window.partitionBy("qid").orderBy(F.desc("ub"), "cid")
    left = materialise(found.join(reach, "qid").where("floor is null or ub >= floor")
                       .withColumn("_n", F.row_number().over(by_ub)).select("qid", "cid", "ub", "_n"), "in_order")
    vectors = classes.select("cid", "vec")
    first = materialise(_read_exact(left.where(F.col("_n") <= want), vectors, queries), "first")
    certain = first.groupBy("qid").agg(F.min("score").alias("kth"))
    second = _read_exact(left.where(F.col("_n") > want).join(certain, "qid").where("ub >= kth"), vectors, queries)

    # classes in order of score and smallest id, then their rows
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    by_row = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = first.unionByName(second).withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= want) \
        .join(classes.select("cid", "ids"), "cid") \
        .select("qid", "score", F.explode("ids").alias("vec_id")) \
        .withColumn("_n", F.row_number().over(by_row)).where(F.col("_n") <= want)
    lists = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("top"))
    own = F.filter("top", lambda x: x["vec_id"] != F.col("query_id"))
    return query_ids.join(lists, "qid").select(
        "query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
