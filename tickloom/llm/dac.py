"""Token files of directly addressable codes.

A segment holds the ids of consecutive documents. Each id is split into 8-bit chunks: level 0 has
the low chunk of every id, level n + 1 the next chunk of those ids that have one. A bitmap beside
each level tells which ids go on, and a rank directory counts its ones before every 512 bits, so
the id at any position is read with one look-up a level and nothing is decoded in between.

The files are Parquet: one row a segment, with the documents it holds, their lengths and the
code. Rows lie in ascending document order within a file part, parts in ascending order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import encoding
from tickloom.llm.common import kept, local, pieces, text_or_empty

MAGIC, BITS, SEGMENT = b"DAC1", 512, 1 << 18
FILE = ("part int, seq int, first_in_part long, n_tokens long, doc_ids array<bigint>, "
        "lengths array<bigint>, code binary")


def encode(ids: np.ndarray) -> bytes:
    """The code of unsigned 32-bit ids."""
    rest, levels = np.ascontiguousarray(ids, np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BITS)) if len(more) else []
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes()
                      + bitmap.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Code:
    """Reads a code in place."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token code")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            n, = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", -(-n // BITS) + 1, at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, ranks))
            at += 8 + n + len(bitmap) + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, at: int) -> int:
        """Ones in the bitmap before a position."""
        _, bitmap, ranks = self.levels[level]
        block = at // BITS
        bits = np.unpackbits(bitmap[block * BITS // 8:(at + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(bits[:at - block * BITS].sum())

    def __getitem__(self, at: int) -> int:
        value = shift = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[at]) << shift
            if not bitmap[at >> 3] >> (at & 7) & 1:
                break
            at, shift = self.rank(level, at), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids at start..end-1; reads nothing outside."""
        value, where = np.zeros(end - start, np.uint32), np.arange(end - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            low = start // 8
            more = np.unpackbits(bitmap[low:(end + 7) // 8], bitorder="little")[
                start - 8 * low:end - 8 * low].astype(bool)
            where = where[more]
            if not len(where):
                break
            start = self.rank(level, start)
            end = start + len(where)
        return value


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, and writes the token files to `path`.

    Documents are ordered by id, nulls first, equal ids by a hash of the text. Null or empty
    text: end_id alone. A special string of the vocabulary inside a text gets its own id, as the
    library does it. An empty table writes files without rows. Other columns are not read.
    """
    key = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", key)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        encoder = kept(f"bytes:{vocabulary}", lambda: encoding.byte_level(vocabulary, encoding.LARGE))
        doc_ids, arrays, held = [], [], 0
        end = np.array([end_id], np.uint32)

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": [part], "seq": [seq], "first_in_part": [before], "n_tokens": [held],
                "doc_ids": [doc_ids], "lengths": [[len(a) for a in arrays]],
                "code": [encode(np.concatenate(arrays))]}, schema=pa.schema([
                    ("part", pa.int32()), ("seq", pa.int32()), ("first_in_part", pa.int64()),
                    ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("code", pa.binary())]))

        for batch in batches:
            for low, high in pieces(batch, "text", 1 << 22):
                some = batch.slice(low, high - low)
                found = encoder(some.column("text").to_pylist())
                for doc_id, ids in zip(some.column("id").to_pylist(), found):
                    if held >= SEGMENT:
                        yield segment()
                        seq, before, doc_ids, arrays, held = seq + 1, before + held, [], [], 0
                    doc_ids.append(doc_id)
                    arrays.append(np.concatenate([ids, end]))
                    held += len(ids) + 1
        if held:
            yield segment()

    # the codes are dense already
    ordered.mapInArrow(segments, FILE).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `first`, the number of ids before each in all files."""
    files = spark.read.schema(FILE).parquet(path)
    totals = sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect()))
    firsts, before = [], 0           # a row for each part: its number is that of write tasks
    for part, n in totals:
        firsts.append((part, before))
        before += n
    offsets = local(spark, firsts, pa.schema([("part", pa.int32()), ("before", pa.int64())]))
    return files.join(offsets, "part").withColumn("first", F.expr("before + first_in_part")).drop(
        "before")


def token_at(tokens: DataFrame, position: int) -> int | None:
    """The id at a position of all files, or None beyond them."""
    hit = tokens.filter((F.col("first") <= position)
                        & (F.lit(position) < F.col("first") + F.col("n_tokens"))).first()
    return None if hit is None else Code(bytes(hit["code"]))[position - hit["first"]]


def document_tokens(tokens: DataFrame, digests_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless digests_only, the ids of each document."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()
                code, lengths, start = Code(get("code")), get("lengths"), get("first")
                ends = np.cumsum(lengths)
                ids = np.split(code.slice(0, len(code)).astype("<u4"), ends[:-1])
                out = {"doc_id": get("doc_ids"), "start": (start + ends - lengths).tolist(),
                       "n_tokens": lengths, "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids]}
                if not digests_only:
                    out["ids"] = [i.astype(np.int64) for i in ids]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("ids_crc32", pa.int64())] + ([] if digests_only else
                                                   [("ids", pa.list_(pa.int64()))])))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return tokens.select("first", "doc_ids", "lengths", "code").mapInArrow(
        documents, schema if digests_only else schema + ", ids array<bigint>")
