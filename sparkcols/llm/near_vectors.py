"""Nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Candidates are hashed in bands of length: each is scaled by the largest length
of its band and lifted by one component to the unit sphere, queries are scaled
to it, so that in a band a larger inner product is a smaller distance. In each table a vector lies in the cell of its rounded-down
Gaussian projections. A query visits the cells around its own in the order of
their estimated success: the smaller the squared distances to the boundaries
that a shift crosses, the sooner. It visits them in every band. A query that
finds fewer than k rows so is compared with all candidates. Scores are taken on
the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcols.llm.shipping import map_arrow, ship
from sparkcols.session import staged

#: tables, projections of each, width of a cell on the unit sphere, cells that a query visits in each table
TABLES, PROJECTIONS, WIDTH, PROBES = 4, 4, 1.5, 30
#: lengths of a band: up to 2 ** BAND times its shortest
BAND = 0.25
#: rows of a cell that one task compares at a time, on either side
MEMBERS, ASKERS = 4096, 1024
SHIFTS = np.array(list(product((-1, 0, 1), repeat=PROJECTIONS)))


def cell_keys(lifted: np.ndarray, number: int, probes: int) -> np.ndarray:
    """Keys of each vector's first ``probes`` cells in a table, its own first."""
    rng = np.random.default_rng([number, lifted.shape[1]])
    places = lifted @ rng.normal(size=(lifted.shape[1], PROJECTIONS)) + rng.uniform(0, WIDTH, PROJECTIONS)
    cells = np.floor(places / WIDTH)
    below = places - cells * WIDTH
    cost = np.stack([below**2, np.zeros_like(below), (WIDTH - below) ** 2], -1)
    total = sum(cost[:, j, :][:, SHIFTS[:, j] + 1] for j in range(PROJECTIONS))
    order = np.argsort(total, 1, kind="stable")[:, :probes]
    visited = cells.astype(np.int64)[:, None, :] + SHIFTS[order]
    weights = 4096 ** np.arange(PROJECTIONS, dtype=np.int64)
    return (visited + 2048) @ weights


def hashed(rows: DataFrame, probes: int) -> DataFrame:
    """(id, vec, band, dim, number, key): a row for each table and visited cell of ``rows`` (id, vec, band, longest).

    A vector is scaled by ``longest``, and to length 1 where that is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    own = part.take(pa.array(np.flatnonzero(sizes == dim)))
                    vectors = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
                    peak = np.abs(vectors).max(1, keepdims=True)
                    length = peak * np.sqrt(((vectors / peak) ** 2).sum(1, keepdims=True))
                    longest = own.column(3).to_numpy(zero_copy_only=False)[:, None]
                    share = vectors / np.where(longest > 0, longest, length)
                    lift = np.where(longest[:, 0] > 0, np.sqrt(np.maximum(1 - (share**2).sum(1), 0)), 0)
                    lifted = np.column_stack([share, lift])
                    for number in range(TABLES):
                        keys = cell_keys(lifted, number, probes)
                        again = own.take(pa.array(np.repeat(np.arange(len(own)), keys.shape[1])))
                        n = len(again)
                        yield pa.RecordBatch.from_arrays(
                            [
                                again.column(0),
                                again.column(1),
                                again.column(2),
                                pa.array(np.full(n, dim, np.int32)),
                                pa.array(np.full(n, number, np.int32)),
                                pa.array(keys.ravel()),
                            ],
                            ["id", "vec", "band", "dim", "number", "key"],
                        )

    kind = rows.schema["vec"].dataType.simpleString()
    return map_arrow(rows, run, f"id long, vec {kind}, band int, dim int, number int, key long")


def products(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Inner products, each summed component by component: equal vectors get equal scores in every block."""
    out = np.zeros((len(queries), len(members)))
    columns = np.ascontiguousarray(members.T)
    for a in range(0, len(queries), 32):
        for j in range(columns.shape[0]):
            out[a : a + 32] += queries[a : a + 32, j, None] * columns[j][None, :]
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best other ids, ties to the smaller id; ``ids`` ascend."""
    scores = np.where(own[:, None] == ids[None, :], -np.inf, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, 1)[:, -k]
        good = scores >= least[:, None]
        for row in np.flatnonzero(good.sum(1) > k):  # ties at the last place
            tied = np.flatnonzero(scores[row] == least[row])
            good[row, tied[k - int((scores[row] > least[row]).sum()) :]] = False
    else:
        good = np.ones(scores.shape, bool)
    rows, columns = np.nonzero(good & (scores > -np.inf))
    return rows, columns


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, asks: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best rows found for every row where ``asks`` holds.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without a key; only vectors of equal length are
    compared. A row isn't its own neighbour; rows with a repeated key and vector
    count once. Cells of many rows are cut into blocks on both sides, every
    pair of which is compared. Other columns are not looked at.
    """
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    # a repeated key and vector would take the place of another row among a block's k best
    rows = rows.groupBy("id", "vec").agg(F.max("asks").alias("asks"))
    size = F.aggregate("vec", F.lit(0.0), lambda s, x: F.hypot(s, x.cast("double")))
    rows = rows.withColumn("length", size).withColumn("band", F.floor(F.log2("length") / BAND).cast("int"))
    rows = staged(rows.withColumn("dim", F.size("vec")), "vectors")
    # a row for each band of lengths, at most some thousand
    bands = rows.groupBy("dim", "band").agg(F.max("length").alias("longest"))
    banded = rows.join(F.broadcast(bands), ["dim", "band"])
    asking = rows.where("asks").select("id", "vec", "band", F.lit(0.0).alias("longest"))
    members = staged(hashed(banded.select("id", "vec", "band", "longest"), 1), "members")
    queries = staged(hashed(asking, PROBES).drop("band"), "queries")
    place = ["dim", "number", "key"]
    sizes = members.groupBy("band", *place).agg(F.count("*").alias("n"))
    asked = queries.groupBy(*place).agg(F.count("*").alias("m"))
    blocks = staged(
        sizes.join(asked, place).select(
            "band", *place, F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"), F.ceil(F.col("m") / ASKERS).cast("int").alias("turns")
        ),
        "blocks",
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = queries.join(blocks, place).withColumn("turn", some("turns")).withColumn("part", every("parts"))
    right = members.join(blocks, ["band", *place]).withColumn("part", some("parts")).withColumn("turn", every("turns"))
    ship(df.sparkSession)

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        two = two.sort_values("id", kind="stable")
        ids, own = two["id"].to_numpy(), one["id"].to_numpy()
        x, y = np.stack(one["vec"].to_numpy()).astype(float), np.stack(two["vec"].to_numpy()).astype(float)
        scores = products(x, y)
        # ids with several vectors take several places
        r, c = best(scores, ids, own, k * int(np.unique(ids, return_counts=True)[1].max()))
        return pd.DataFrame({"query_id": own[r], "vec_id": ids[c], "score": scores[r, c]})

    def compared(asking: DataFrame, held: DataFrame, group: list[str]) -> DataFrame:
        pairs = (
            asking.select("id", "vec", *group)
            .groupBy(*group)
            .cogroup(held.select("id", "vec", *group).groupBy(*group))
            .applyInPandas(compare, "query_id long, vec_id long, score double")
        )
        return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = staged(compared(left, right, ["band", *place, "part", "turn"]), "near-vectors")
    # queries that found fewer than k rows are compared with all candidates, block by block
    many = found.groupBy("query_id").agg(F.count("*").alias("hits"))
    short = rows.where("asks").join(many, F.col("id") == F.col("query_id"), "left").where(F.coalesce("hits", F.lit(0)) < k)
    short = staged(short.select("id", "vec", "dim"), "short-queries")
    all_sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    all_blocks = short.groupBy("dim").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("turns")).join(all_sizes, "dim")
    all_blocks = F.broadcast(staged(all_blocks, "all-blocks"))
    left = short.join(all_blocks, "dim").withColumn("turn", some("turns")).withColumn("part", every("parts"))
    right = rows.join(all_blocks, "dim").withColumn("part", some("parts")).withColumn("turn", every("turns"))
    found = found.unionByName(compared(left, right, ["dim", "part", "turn"]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
