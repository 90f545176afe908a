"""Exact top-k search by inner product, with a three-phase uniform threshold.

Each component range of the vectors is a *list* of local scores per query. Phase 1
gathers the head of every list and resolves the vectors seen there, which gives a
safe lower bound of the k-th score. Phase 2 sends every list a cutoff, so chosen that
a vector below all cutoffs cannot reach the bound, and collects the entries above.
Phase 3 drops what cannot reach the bound any more and resolves the rest exactly.

Equal vectors are searched once: a class stands for them, with its smallest ids and how
many rows each has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from camwatch.llm.common import table

#: Stands for no score; below any other and exact in every type used.
NONE = -(2**62)
NO_PARTS = pd.DataFrame({"q": [], "list": [], "c": [], "part": []}).astype("int64")
#: Vectors and queries of one block, and queries that are scored at once.
BLOCK, QUERY_BLOCK, TILE = 32_768, 4096, 256


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: floor(scale * x) of each component; rows with a null vector or a null or non-finite component are left out."""
    whole = lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e")).filter(F.col("id").isNotNull() & F.col("e").isNotNull()).filter(
        F.coalesce(F.expr("forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"), F.lit(False))
    ).select("id", F.transform("e", whole).alias("v"))


def fits(vectors: DataFrame) -> None:
    """Raise if a score, or what is added up on the way to it, might not fit 64 bits: no inner product exceeds the largest square of a length."""
    square = F.expr("aggregate(v, 0d, (s, x) -> s + cast(x as double) * cast(x as double))")
    if (largest := vectors.agg(F.max(square)).first()[0] or 0) >= 2**61:
        raise ValueError(f"scores up to {largest:.3g} don't fit 64 bits; take a smaller scale")


def _stack(column: pd.Series, size: int) -> np.ndarray:
    """Rows of any length as one matrix; missing components are 0."""
    out = np.zeros((len(column), size), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _scores(q: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
    """Inner products, exact: in the narrowest type that holds every sum."""
    size = max([0, *map(len, q["v"]), *map(len, v["v"])])
    a, b = _stack(q["v"], size), _stack(v["v"], size)
    bound = size * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _blocks(queries: DataFrame, vectors: DataFrame, lists: int, of: Callable, kind: str) -> DataFrame:
    """``of(queries, vectors)`` for each list and pair of blocks; a block has about QUERY_BLOCK queries or BLOCK vectors."""
    nq, nv = queries.count() // QUERY_BLOCK + 1, vectors.count() // BLOCK + 1
    wide = max(1, -(-(vectors.agg(F.max(F.size("v"))).first()[0] or 0) // lists))  # components of a list, but the last has the rest
    size = F.when(F.col("list") == lists - 1, F.greatest(F.size("v"), F.lit(1))).otherwise(wide)
    cut = lambda df: df.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).withColumn("v", F.slice("v", F.col("list") * wide + 1, size))
    q = cut(queries.withColumn("qb", F.pmod(F.hash("id"), F.lit(nq))).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))))
    v = cut(vectors.withColumn("vb", F.pmod(F.hash("id"), F.lit(nv))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))))
    return q.groupBy("list", "qb", "vb").cogroup(v.groupBy("list", "qb", "vb")).applyInPandas(of, kind)


def top_k(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    lists: int = 2,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products.

    ``queries`` has the same columns; by default every vector is a query. A query
    never meets rows of its own id; ties go to the smaller id; with fewer than k other
    rows all are returned. Vectors that are null or hold null or non-finite components
    take no part, on either side, nor do rows without an id; of different lengths the
    shorter is filled up with 0. Every row counts: of rows that repeat an id each is a
    candidate and, among the queries, a query with k rows of its own. Scores are exact;
    vectors so long that one might not fit 64 bits are refused. Empty tables give an
    empty result; other columns are ignored.
    """
    v = table(quantise(vectors, id_col, vector_col, scale), "quantised")
    q = v if queries is None else table(quantise(queries, id_col, vector_col, scale), "queries")
    fits(v if queries is None else v.unionByName(q))
    need = k + 1  # ids of a class that can count: the query itself may be among them
    counted = table(v.groupBy("v", "id").agg(F.count("*").alias("rows")), "counted")
    # ids with several vectors: a class has one such id only, or none, so that a query leaves out whole classes besides its own rows
    many = table(counted.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("split")), "many")
    marked = lambda rows: rows.join(many, "id", "left").select(*rows.columns, F.col("split").isNotNull().alias("split"), F.when(F.col("split"), F.col("id")).otherwise(0).alias("lone"))
    kind = ["v", "split", "lone"]
    # the smallest ids of each class of equal vectors, with their rows: Spark keeps `need` ids a class before the shuffle
    low = marked(counted).withColumn("r", F.row_number().over(W.partitionBy(*kind).orderBy("id"))).filter(F.col("r") <= need)
    classes = low.groupBy(*kind).agg(F.min("id").alias("least"), F.array_sort(F.collect_list(F.struct("id", F.least("rows", F.lit(k)).cast("int").alias("rows")))).alias("ids"))
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    points = classes.select("id", *kind)
    # a query's own class would lead every list: it is scored apart, and the lists are those of the others
    q = table(marked(q), "marked")
    qc = q.groupBy(*kind).agg(F.count("*").alias("asking")).withColumn("id", F.monotonically_increasing_id())
    qc = table(qc.join(points.select("v", "split", F.col("id").alias("own")).filter("not split"), ["v", "split"], "left"), "query_classes")
    qc = qc.select("id", *kind, F.col("own").isNotNull().alias("has_own"), F.coalesce("own", F.lit(0)).alias("own"))

    def tiles(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Scores of a block, a few queries at a time; a query's own class has none."""
        for low in range(0, len(a), TILE):
            yield (tile := a.iloc[low : low + TILE]), parts(tile, b)

    def parts(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        s = _scores(a, b)
        i, j = np.nonzero((a["own"].to_numpy()[:, None] == b["id"].to_numpy()) & a["has_own"].to_numpy()[:, None])
        s[i, j] = NONE
        if a["split"].any():
            i, j = np.nonzero((a["lone"].to_numpy()[:, None] == b["lone"].to_numpy()) & (a["split"].to_numpy()[:, None] & b["split"].to_numpy()))
            s[i, j] = NONE
        return s

    def found(a: pd.DataFrame, b: pd.DataFrame, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"q": a["id"].to_numpy()[i], "list": a["list"].iloc[0], "c": b["id"].to_numpy()[j], "part": s[i, j].astype(np.int64)})

    def head(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return NO_PARTS
        n, out = min(k, len(b)), []
        for tile, s in tiles(a, b):
            j = np.argpartition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :].ravel()
            i = np.repeat(np.arange(len(tile)), n)
            some = s[i, j] != NONE
            out.append(found(tile, b, i[some], j[some], s))
        return pd.concat(out)

    heads = _blocks(qc, points, lists, head, "q long, list int, c long, part long")
    heads = table(heads.withColumn("r", F.row_number().over(W.partitionBy("q", "list").orderBy(F.desc("part"), "c"))).filter(F.col("r") <= k), "heads")
    dot = F.expr("aggregate(zip_with(qv, cv, (x, y) -> coalesce(x, 0L) * coalesce(y, 0L)), 0L, (s, x) -> s + x)")
    qv, cv = qc.select(F.col("id").alias("q"), F.col("v").alias("qv")), points.select(F.col("id").alias("c"), F.col("v").alias("cv"))
    resolve = lambda pairs: pairs.join(cv, "c").join(qv, "q").withColumn("score", dot).drop("qv", "cv")
    seen = resolve(heads.select("q", "c").distinct())
    w = W.partitionBy("q").orderBy(F.desc("score"), "c")
    bound = seen.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("q", F.col("score").alias("bound"))
    # cutoff of a list: its highest part less an equal share of what the highest parts exceed the bound by
    tops = heads.groupBy("q", "list").agg(F.max("part").alias("top"))
    room = tops.groupBy("q").agg(F.sum("top").alias("tops")).join(bound, "q", "left")
    cuts = table(
        tops.join(room, "q").select("q", "list", "bound", F.when(F.col("bound").isNull(), F.lit(NONE + 1)).otherwise(F.expr(f"top - (tops - bound + {lists - 1}) div {lists}")).cast("long").alias("cut")),
        "cuts",
    )
    with_cuts = table(qc.join(cuts.groupBy(F.col("q").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("list", "cut"))).alias("cuts")), "id"), "cutoffs")

    def above(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return NO_PARTS
        one, out = int(a["list"].iloc[0]), []
        for tile, s in tiles(a, b):
            cut = np.array([dict(x)[one] for x in tile["cuts"]], s.dtype)
            out.append(found(tile, b, *np.nonzero((s >= cut[:, None]) & (s != NONE)), s))  # without a bound the cutoff rounds to NONE
        return pd.concat(out)

    entries = _blocks(with_cuts, points, lists, above, "q long, list int, c long, part long")
    total = cuts.groupBy("q").agg(F.sum("cut").alias("cut_sum"), F.first("bound").alias("bound"))
    # what a vector can reach at most: its parts that were sent, and the cutoffs of the other lists
    most = (
        entries.join(cuts.select("q", "list", "cut"), ["q", "list"])
        .groupBy("q", "c").agg(F.sum("part").alias("parts"), F.sum("cut").alias("met"), F.count("*").alias("lists"))
        .join(total, "q").filter("bound is null or parts + cut_sum - met >= bound")
    )
    most = table(most.select("q", "c", "parts", "lists"), "candidates")
    exact = most.filter(F.col("lists") == lists).select("q", "c", F.col("parts").alias("score"))
    exact = exact.unionByName(resolve(most.filter(F.col("lists") < lists).select("q", "c")).select("q", "c", "score"))
    own = qc.filter("has_own").select(F.col("id").alias("q"), F.col("own").alias("c"), F.expr("aggregate(v, 0L, (s, x) -> s + x * x)").alias("score"))
    # ties go to the class with the smallest id
    best = exact.join(classes.select(F.col("id").alias("c"), "least"), "c").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "least"))).filter(F.col("r") <= k)
    best = best.select("q", "c", "score").unionByName(own)
    rows = best.join(classes.select(F.col("id").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("one"))
    # of each query class the `need` best ids: one of them may be the query's own
    rows = rows.select("q", "score", F.col("one.id").alias("vec_id"), F.col("one.rows").alias("rows"))
    rows = rows.withColumn("r", F.dense_rank().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= need).drop("r")
    rows = table(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))), "best")
    asked = q.withColumn("row", F.monotonically_increasing_id()).join(qc.select(F.col("id").alias("q"), *kind), kind).select(F.col("id").alias("query_id"), "row", "q")
    each = asked.join(rows, "q").filter("vec_id <> query_id")
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return each.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
