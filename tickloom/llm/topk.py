"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into buckets of at most `BUCKET` rows, queries into blocks of at most
`BLOCK`; both are packed, one binary row each. A first pass over the buckets of greatest length
gives each query a lower bound of its k-th score. Then every (block, bucket) pair whose length
bound can reach a threshold is searched: a query's local cosine threshold, its bound over the
product of lengths, picks the pruning. High thresholds prune by coordinate (a vector at that
cosine lies in a computable interval on the query's strongest coordinates), low ones by length (a
prefix of the bucket). What remains is verified by its integer product.

The pairs of blocks are the stated query set against all rows; no row is ever paired in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

BUCKET, BLOCK = 2048, 512
LARGEST = 2.0 ** 62        # squared lengths up to here: no product of two vectors exceeds a long
SPREAD = 256               # groups of buckets that blocks of queries are paired with apart
COSINE, FOCUS = 0.8, 5     # coordinate pruning from this local threshold on, by so many coordinates
PACKED = ("dim int, low_norm double, top_norm double, n int, ids binary, body binary, "
          "lows binary")


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """id, v (floor(scale * x) per component), dim and sq (squared length), distinct.

    Left out: null ids, null or empty vectors, vectors with a null, NaN or infinite component, and
    those whose integers have a squared length of 2^62 or more (for one component, from 33 million
    on), whose scores a long may not hold. Repeated rows with the same id and vector count once.
    """
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).filter(
        "id is not null and x is not null and size(x) > 0").filter(F.forall("x", lambda c: (
            c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < math.sqrt(LARGEST) / scale))))
    floors = F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    good = good.filter(F.aggregate(floors, F.lit(0.0), lambda a, c: a + c * c) < LARGEST)
    vectors = good.select("id", F.transform(
        "x", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))
    return vectors.distinct().select("id", "v", F.size("v").alias("dim"), F.aggregate(
        "v", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c.cast("long")).alias("sq"))


def packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows of one dimension, in descending length, `rows` at most to a block; `at` numbers it."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dim = [], None
        for batch in batches:
            for record in zip(*(batch.column(c).to_pylist() for c in ("dim", "id", "v", "sq"))):
                if held and (record[0] != dim or len(held) == rows):
                    yield block(held, dim)
                    held = []
                dim = record[0]
                held.append(record)
        if held:
            yield block(held, dim)

    def block(held: list, dim: int) -> pa.RecordBatch:
        norms = np.sqrt(np.array([r[3] for r in held], np.float64))
        ids = np.array([r[1] for r in held], np.int64)
        body = np.array([r[2] for r in held], np.int32)
        return pa.RecordBatch.from_pylist([{
            "dim": dim, "low_norm": norms[-1], "top_norm": norms[0], "n": len(held),
            "ids": ids.tobytes(), "body": body.tobytes(), "lows": norms.tobytes()}],
            schema=pa.schema([("dim", pa.int32()), ("low_norm", pa.float64()),
                              ("top_norm", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()),
                              ("body", pa.binary()), ("lows", pa.binary())]))

    order = [F.col("dim"), F.col("sq").desc(), F.col("id")]
    return written(vectors.repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(pack, PACKED).withColumn("at", F.monotonically_increasing_id()),
                   name)


def top_k(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query row.

    A row is no candidate of a query with its own id. Ties go to the smaller id. Vectors that
    integer_vectors leaves out take no part; vectors meet those of their own dimension only. Two
    different vectors under one id are two rows and, as queries, two lists. Empty tables and
    queries without candidates give no rows.
    """
    vectors = written(integer_vectors(rows, id_col, vec_col, scale), "topk-vectors")
    asked = vectors.filter(F.coalesce(queries, F.lit(False)))
    buckets = packed(vectors, BUCKET, "topk-buckets")
    blocks = packed(asked, BLOCK, "topk-queries").select(
        "dim", F.col("top_norm").alias("q_top"), F.col("n").alias("q_n"),
        F.col("ids").alias("q_ids"), F.col("body").alias("q_body"), F.col("lows").alias("q_norms"),
        F.col("at").alias("q_at"))
    first = buckets.groupBy("dim").agg(F.max_by("at", F.struct("top_norm", "n")).alias("at"))
    start = blocks.join(buckets.join(first, ["dim", "at"]), "dim")
    bounds = written(_bounds(_searched(start.withColumn("floors", F.lit(None).cast("array<double>")), k),
                             k), "topk-bounds")
    groups = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("group")
    pairs = (blocks.select("q_at", "dim", "q_top").join(bounds.select("q_at", "least"), "q_at")
             .select("*", groups)
             .join(buckets.select("dim", "at", "top_norm", F.pmod(F.hash("at"), F.lit(SPREAD))
                                  .alias("group")), ["dim", "group"])
             .filter("q_top * top_norm * (1 + 1e-9) >= least").select("q_at", "at"))
    work = (pairs.join(buckets.drop("dim", "low_norm"), "at").join(blocks, "q_at")
            .join(bounds.select("q_at", "floors"), "q_at"))
    found = _searched(work, k)
    best = Window.partitionBy("q_at", "slot").orderBy(F.col("score").desc(), "vec_id")
    return (found.filter("vec_id is not null").withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _bounds(seen: DataFrame, k: int) -> DataFrame:
    """Per block: the lower bounds of its queries' k-th scores and the least of them."""
    worst = seen.groupBy("q_at", "slot").agg(
        F.when(F.count("vec_id") >= k, F.min("score")).alias("floor"))
    return worst.groupBy("q_at").agg(
        F.min(F.coalesce(F.col("floor").cast("double"), F.lit(-math.inf))).alias("least"),
        F.sort_array(F.collect_list(F.struct("slot", "floor"))).alias("held")).select(
        "q_at", "least", F.transform("held", lambda x: F.coalesce(
            x["floor"].cast("double"), F.lit(-math.inf))).alias("floors"))


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each pair, above the bounds; one row without vec_id for a query
    that finds none."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from one(row)

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        dim = row["dim"]
        ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lows"])
        vectors = np.frombuffer(row["body"], np.int32).reshape(-1, dim)
        q_ids, q_norms = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_norms"])
        queries = np.frombuffer(row["q_body"], np.int32).reshape(-1, dim)
        floors = (np.full(len(q_ids), -np.inf) if row["floors"] is None
                  else np.array(row["floors"], np.float64))
        exact = norms.max(initial=0) * q_norms.max(initial=0) < 2.0 ** 52
        kind = np.float64 if exact else np.int64
        body, asked = vectors.astype(kind), queries.astype(kind)
        units = vectors / np.where(norms > 0, norms, 1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = floors / (q_norms * norms.max(initial=0))
            reach = np.where(q_norms > 0, floors / q_norms, np.where(floors > 0, np.inf, -np.inf))
        # lengths descend: a query whose bound is positive needs a prefix of the bucket
        prefix = np.where(reach > 0, np.searchsorted(-norms, -reach * (1 - 1e-9), "right"),
                          len(ids))
        by_length = ~(cosine >= COSINE)
        wide = int(prefix[by_length].max(initial=0))
        products = body[:wide] @ asked[by_length].T
        column = np.cumsum(by_length) - 1
        out = {"q_at": [], "slot": [], "query_id": [], "vec_id": [], "score": []}
        for slot in range(len(q_ids)):
            if by_length[slot]:
                rows = np.arange(prefix[slot])
                scores = products[:prefix[slot], column[slot]]
            else:
                rows = coordinates(units[:prefix[slot]], queries[slot] / q_norms[slot],
                                   cosine[slot])
                scores = body[rows] @ asked[slot]
            good = (scores >= floors[slot]) & (ids[rows] != q_ids[slot])
            rows, scores = rows[good], scores[good].astype(np.int64)
            best = np.lexsort((ids[rows], -scores))[:k]
            n = max(len(best), 1)
            out["q_at"] += [row["q_at"]] * n
            out["slot"] += [slot] * n
            out["query_id"] += [int(q_ids[slot])] * n
            out["vec_id"] += ids[rows[best]].tolist() or [None]
            out["score"] += scores[best].tolist() or [None]
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("q_at", pa.int64()), ("slot", pa.int32()), ("query_id", pa.int64()),
             ("vec_id", pa.int64()), ("score", pa.int64())]))

    def coordinates(units: np.ndarray, query: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that can reach the cosine, judged on the query's strongest coordinates."""
        kept = np.arange(len(units))
        other = math.sqrt(max(0.0, 1 - min(cosine, 1.0) ** 2))
        for f in np.argsort(-np.abs(query), kind="stable")[:FOCUS]:
            middle, spread = query[f] * cosine, other * math.sqrt(max(0.0, 1 - query[f] ** 2))
            # the interval of coordinate f over all unit vectors with at least this cosine
            high = 1.0 if query[f] >= cosine else middle + spread
            low = -1.0 if -query[f] >= cosine else middle - spread
            value = units[kept, f]
            kept = kept[(value >= low - 1e-9) & (value <= high + 1e-9)]
        return kept

    return pairs.mapInArrow(search, "q_at long, slot int, query_id long, vec_id long, score long")
