"""Exact top-k by inner product over a pivot-distance index.

Vectors of norm r get one more coordinate, sqrt(M^2 - r^2) with M the largest norm, so
that the largest inner product is the smallest distance. Each vector is keyed by its
nearest pivot and its distance to it. By the triangle inequality an annulus [a, b] around
a pivot at distance d from the query holds nothing nearer than max(a - d, d - b, 0). A
query first reads the annulus it falls into, then all others, sorted by that bound, until
the bound passes its k-th best; both steps run over blocks of queries and vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SCALE = 256
K = 5
EVERY = 50
PIVOTS = 24
SAMPLE = 4096  # vectors from which the pivots are picked, those with the smallest id hash
RINGS = 12  # annuli of equal width per pivot
BLOCK = 4096  # vectors or queries in one side of a task, about
SLACK = 1e-6  # relative, for rounding in distances; scores are exact integers

FOUND = "query_id long, vec_id long, score long"


def whole_numbers(embedding: Column) -> Column:
    """floor(256 x) of each component; null if the vector or a component is unusable."""
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return F.when(embedding.isNotNull() & ~bad, scaled)


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The mean's nearest vector, then always the vector farthest from all chosen."""
    first = np.argmin(((sample - sample.mean(axis=0)) ** 2).sum(axis=1))
    chosen = [int(first)]
    gap = ((sample - sample[first]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY) -> DataFrame:
    """The ``k`` largest inner products of each query of ``vectors(vec_id, embedding)``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of
    another id and of the query's length. Components count as floor(256 x). Returns
    ``query_id, rank, vec_id, score``, ties to the smaller id; fewer rows where there
    are fewer candidates. Null vectors, vectors with a null or non-finite component,
    empty vectors and rows without an id take no part. Repeated rows of one id and
    vector count once. Equal vectors are indexed once with their ``k`` + 1 smallest ids,
    which is all that a result can need. Other columns are ignored, an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v")
    ).filter("vec_id is not null and v is not null and size(v) > 0").distinct()
    rows = staged(rows, "vectors")
    few = Window.partitionBy("v").orderBy("vec_id")  # limited inside each task first
    distinct = (
        rows.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    queries = rows.filter(F.col("vec_id") % every == 0)
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    out = None
    for n in sorted(lengths):
        same = F.size("v") == n
        found = _one_length(spark, distinct.filter(same), queries.filter(same), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _one_length(spark, distinct: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = float(distinct.agg(F.max(norm)).first()[0])
    sample = distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()
    points = lifted(np.array([r[0] for r in sample]), most)
    pivots = pick_pivots(points, PIVOTS)
    width = float(distances(points, pivots).min(axis=1).max()) * 1.25 / RINGS + 1e-9

    def place(batches):
        for batch in batches:
            away = distances(lifted(stacked(batch.column(0)), most), pivots)
            pivot = away.argmin(axis=1)
            radius = away[np.arange(len(away)), pivot]
            ring = np.floor(radius / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pivot, pa.int32()), pa.array(ring),
                 pa.array(radius)],
                names=["v", "ids", "pivot", "ring", "radius"],
            )

    index = distinct.mapInArrow(
        place, "v array<double>, ids array<long>, pivot int, ring int, radius double"
    )
    index = staged(index, "index")
    # Annuli: rings beyond the sample's reach exist too, so none is left out.
    annuli = index.groupBy("pivot", "ring").agg(
        F.min("radius").alias("inner"), F.max("radius").alias("outer"), F.count("*").alias("n")
    )
    annuli = staged(annuli, "annuli")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    index = index.join(
        F.broadcast(annuli.select("pivot", "ring", blocks.alias("blocks"))), ["pivot", "ring"]
    ).withColumn("part", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))

    def visits(first: bool, inner, outer, pivot_of, parts):
        """Per query the annuli to read: its own at first, then all the bound leaves."""

        def run(batches):
            for batch in batches:
                q = stacked(batch.column(1))
                if not len(q):
                    continue
                square = (q**2).sum(axis=1)
                away = distances(np.column_stack([q, np.zeros(len(q))]), pivots)[:, pivot_of]
                bound = np.maximum(np.maximum(inner - away, away - outer), 0)
                if first:
                    chosen = np.zeros(bound.shape, dtype=bool)
                    chosen[np.arange(len(q)), bound.argmin(axis=1)] = True
                    least = np.full(len(q), -(1 << 62))
                else:
                    least = batch.column(2).to_numpy(zero_copy_only=False)
                    # distance^2 = |q|^2 + M^2 - 2 score
                    reach = np.sqrt(np.maximum(square + most - 2.0 * least, 0))
                    chosen = bound <= reach[:, None] * (1 + SLACK) + SLACK
                    chosen[np.arange(len(q)), bound.argmin(axis=1)] = False  # read already
                who, which = np.nonzero(chosen)
                ids = batch.column(0).to_numpy()
                who, which = np.repeat(who, parts[which]), np.repeat(which, parts[which])
                step = np.arange(len(who)) - np.searchsorted(
                    who * len(parts) + which, who * len(parts) + which
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[who]), batch.column(1).take(pa.array(who)),
                     pa.array(least[who], pa.int64()), pa.array(which, pa.int32()),
                     pa.array(step, pa.int32())],
                    names=["query_id", "v", "least", "annulus", "part"],
                )

        return run

    # The directory is bounded by pivots and occupied rings; it steers each query.
    table = annuli.orderBy("pivot", "ring").collect()
    inner, outer = np.array([r["inner"] for r in table]), np.array([r["outer"] for r in table])
    pivot_of = np.array([r["pivot"] for r in table])
    parts = np.array([-(-r["n"] // BLOCK) for r in table])
    names = spark.createDataFrame(
        [(r["pivot"], r["ring"], n) for n, r in enumerate(table)], "pivot int, ring int, annulus int"
    )
    index = index.join(F.broadcast(names), ["pivot", "ring"]).select("annulus", "part", "v", "ids")
    # Queries of a block in sets of about BLOCK, so a block is copied no more than that needs.
    splits = max(1, -(-queries.count() // BLOCK))
    schema = "query_id long, v array<double>, least long, annulus int, part int"

    def read(wanted: DataFrame) -> DataFrame:
        """Best of each visited block; a busy block is copied for several sets of queries."""
        wanted = wanted.withColumn("side", F.pmod(F.xxhash64("query_id"), F.lit(splits)).cast("int"))
        keys = ["annulus", "part", "side"]
        asked = wanted.select(*[F.col(c).alias(f"asked_{c}") for c in keys]).distinct()
        here = (F.col("annulus") == F.col("asked_annulus")) & (F.col("part") == F.col("asked_part"))
        held = index.join(asked, here).select(
            F.col("asked_annulus").alias("annulus"), F.col("asked_part").alias("part"),
            F.col("asked_side").alias("side"), F.col("v").alias("v"), F.col("ids").alias("ids"),
        )
        return wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best_of(k), FOUND)

    ids = queries.select("vec_id", "v")
    near = staged(best(read(ids.mapInArrow(visits(True, inner, outer, pivot_of, parts), schema)), k), "near")
    kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    bounded = ids.join(kth, "vec_id", "left").select(
        "vec_id", "v", F.coalesce("least", F.lit(-(1 << 62))).alias("least")
    )
    rest = read(bounded.mapInArrow(visits(False, inner, outer, pivot_of, parts), schema))
    return best(near.select("query_id", "vec_id", "score").union(rest), k)


def best_of(k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if asked.num_rows and held.num_rows:
            q = stacked(asked["v"].combine_chunks())
            x = stacked(held["v"].combine_chunks())
            ids = held["ids"].to_pylist()
            names, least = asked["query_id"].to_pylist(), asked["least"].to_numpy()
            for at in range(0, len(q), 256):
                scores = q[at : at + 256] @ x.T  # exact: integers far below 2^53
                for row, own, floor in zip(scores, names[at : at + 256], least[at : at + 256]):
                    # k + 1 vectors: one of them may be the query's own, with no other id.
                    enough = max(np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k + 1 else row.min(), floor)
                    found = [
                        (-int(row[c]), i) for c in np.flatnonzero(row >= enough) for i in ids[c] if i != own
                    ]
                    out += [(own, i, -s) for s, i in sorted(found)[:k]]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({
            "query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
            "score": pa.array(columns[2], pa.int64()),
        })

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
