"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all fingerprints within half the radius of it; two that lie within the
radius meet in one of those variants. An odd radius has half a bit too many: the fingerprint is
cut into blocks, and each of its variants also leaves one block open, so that the one difference
that is left lies there. Variants are shuffled, runs of equal variants are verified by bit
distance, and what links becomes edges, a spanning tree for each run and never all its pairs.
Equal fingerprints are one node, so copies cost nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import forget, pieces, text_or_empty, written
from tickloom.llm.components import components

SHINGLE, RADIUS, BLOCKS, SEED = 3, 3, 3, 42
BITS_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: each is set if more than half of the shingles' hashes have it."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()    # ASCII only, both
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[s:e], SEED) for s, e in zip(
        starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        some = hashes[at:at + BITS_AT_ONCE]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a long) of every row; no words: zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for low, high in pieces(batch, "text", 1 << 22):
                some = batch.slice(low, high - low)
                found = [fingerprint(t, shingle) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("text_hash"),
                     pa.array(np.array(found, np.uint64).view(np.int64))],
                    names=["doc_id", "text_hash", "fp"])

    text = text_or_empty(text_col)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def variants(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(kept bits, flips) of each variant of a fingerprint, as signed 64-bit numbers: the variant
    is (fp & kept) ^ flips. Open blocks hold their number, so blocks don't mix."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)] if radius % 2 else [0, 0]
    found = []
    for block, (low, high) in enumerate(zip(cuts, cuts[1:])):
        open_ = ((1 << high) - 1) ^ ((1 << low) - 1)
        own = [b for b in range(64) if not open_ >> b & 1]
        for n in range(radius // 2 + 1):
            for bits in itertools.combinations(own, n):
                found.append((~open_ & (1 << 64) - 1, sum(1 << b for b in bits)
                              | ((block + 1 << low) & open_)))
    return [tuple(x - (1 << 64) if x >> 63 else x for x in pair) for pair in found]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within radius."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            key, fp = (np.concatenate([r, batch.column(c).to_numpy()])
                       for r, c in zip(rest, ("key", "fp")))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))      # the last run may go on
            yield edges(key[:last], fp[:last])
            rest = [key[last:], fp[last:]]
        yield edges(*rest)

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        two = start[size == 2]
        near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
        found = [(fp[two][near], fp[two + 1][near])]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            found.append(tree(fp[s:s + n]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def tree(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links in a run, found breadth first."""
        rest, queue, a, b = np.unique(run), [], [], []
        while len(rest) or queue:
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            at = queue.pop()
            near = np.bitwise_count(rest.view(np.uint64) ^ np.uint64(at.view(np.uint64))) <= radius
            hit, rest = rest[near], rest[~near]
            a.append(np.full(len(hit), at))
            b.append(hit)
            queue.extend(hit)
        return np.concatenate(a), np.concatenate(b)

    changes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"))
                                  for k, x in variants(radius, blocks)]))
    emitted = prints.select("fp", changes.alias("v")).select(
        F.col("fp").bitwiseAND(F.col("v.k")).bitwiseXOR(F.col("v.x")).alias("key"), "fp")
    return (emitted.repartition("key").sortWithinPartitions("key")
            .mapInArrow(verify, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that names the component) and component_id (the
    smallest doc_id reachable over links, itself included).

    Null or empty text has fingerprint zero and links like any other. Repeated rows and ids share
    a component. A null doc_id never names a component; one of null ids alone has null. Very long
    texts are read whole; an empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(written(links(nodes, radius), "simhash-links"))
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the least doc_id (nulls last), of several texts under
    it that with the least hash. Columns are those of docs."""
    found = near_duplicates(docs, shingle, radius)
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one")).select(
        F.col("one.doc_id").alias("__id"), F.col("one.text_hash").alias("__hash")).distinct()
    ours = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = ours.join(first.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id"))
                     & (F.col("__text_hash") == F.col("__hash")))
    again = Window.partitionBy("__id", "__hash").orderBy("__hash")
    return (kept.withColumn("__n", F.row_number().over(again)).filter("__n = 1")
            .select(*docs.columns))


def hexadecimal(fp):
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
