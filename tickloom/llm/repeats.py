"""Byte passages that occur before, found by a depth-limited radix sort of suffixes.

Only the first `threshold` bytes of a suffix matter: suffixes that agree on them form an equal
group, and all but the earliest suffix of a group start a repeat. The sort goes by digits, most
significant first, and a suffix alone in its bucket is done. Neighbouring suffixes travel together
as runs, so that a corpus is not blown up to a row a byte:

* Digit one is the window's anchor, the gram of `GRAM` bytes with the least hash in it. Windows with
  equal bytes have equal anchors at equal offsets, and neighbours mostly share theirs: a run is the
  windows around one anchor. An anchor met once ends its run; runs with wholly equal bytes are
  decided at once (all but the earliest repeat); runs that differ go on.
* Digit two widens the comparison to all bytes that `CELL` neighbouring windows have in common.
* Digit three is the whole window; its equal groups are exactly the repeated windows.

Every pass decides what it can inside its task first, so a passage in a third of all documents
sends one row a task, not one a document, and a digit with very many different runs in one task
skips the pass (its runs go on; two of them stay so that other tasks' runs go on as well). Digits
are compared by 64-bit hashes of key and content together (128 bits); only offsets and hashes are
shuffled, bytes of undecided runs alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import byte_hash
from tickloom.llm.common import forget, pieces, text_bytes, text_offsets, written

THRESHOLD, GRAM, CELL = 100, 24, 8
PIECE = 1 << 20            # bytes scanned at once; positions in it fit the anchors' low bits
LOW = 22
HELD, HOT = 1 << 20, 512   # runs decided together in a task; different runs of one digit there
START = 31                 # bits of a start (texts hold up to 2^31 bytes); above them 32 bits of the text's hash
NO_ID = -(1 << 63)
CANDIDATE, REPEAT, OPEN = 0, 1, 2
ROW = [("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()),
       ("o", pa.int32()), ("n", pa.int32()), ("kind", pa.int32())]
ROW_DDL = "key long, content long, doc long, at long, o int, n int, kind int"
NAMES = [name for name, _ in ROW]


def _rows(columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
    arrays = [np.ascontiguousarray(c) for c in columns] + [np.full(len(columns[0]), kind)]
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(t.to_pandas_dtype()), t)
         for a, (_, t) in zip(arrays, ROW)], schema=pa.schema(ROW))


def _scattered(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The same rows with a key that spreads them over the tasks."""
    spread = byte_hash.mixed(columns[2].astype(np.uint64) * np.uint64(byte_hash.ODD)
                             + columns[3].astype(np.uint64))
    return [spread, np.zeros(len(spread), np.uint64), *columns[2:]]


def merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray,
           threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, any order, as maximal runs: those that touch or overlap in bytes join."""
    if not len(doc):
        return doc, at, n
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order].astype(np.int64)
    text = np.empty(len(doc), bool)
    text[0] = True
    text[1:] = (doc[1:] != doc[:-1]) | (at[1:] >> START != at[:-1] >> START)
    # ends, running within a text: lifted by a text's rank so that one running maximum serves all
    rank = np.cumsum(text) - 1
    lift = np.int64(1) << np.int64(40)
    start = (at & ((1 << START) - 1)) + rank * lift
    end = np.maximum.accumulate(start + n + threshold - 1)
    first = text.copy()
    first[1:] |= start[1:] > end[:-1]
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], at[begin], end[last] - start[begin] - (threshold - 1)


def decided_here(parts: list[list[np.ndarray]], threshold: int) -> Iterator[pa.RecordBatch]:
    """The rows that a task sends on for its runs: repeats of its own, merged, and candidates.
    Empties `parts`."""
    key, content, doc, at, o, n = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    order = np.lexsort((at, doc, content, key))
    first = np.ones(len(order), bool)
    first[1:] = ((key[order][1:] != key[order][:-1])
                 | (content[order][1:] != content[order][:-1]))
    kept = order[first]
    source = kept[np.cumsum(first) - 1]          # the earliest run with these bytes
    again = order[(doc[order] != doc[source]) | (at[order] != at[source])]
    if len(again):
        runs = merged(doc[again], at[again], n[again], threshold)
        none = np.zeros(len(runs[0]), np.uint64)
        yield _rows(_scattered([none, none, runs[0], runs[1], none, runs[2]]), REPEAT)
    kept = kept[np.argsort(key[kept], kind="stable")]
    new = np.ones(len(kept), bool)
    new[1:] = key[kept][1:] != key[kept][:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    place = np.arange(len(kept)) - np.flatnonzero(new)[group]
    hot = size[group] > HOT
    columns = [key, content, doc, at, o, n]
    sent = kept[~hot | (place < 2)]
    yield _rows([c[sent] for c in columns], CANDIDATE)
    if hot.any():
        yield _rows(_scattered([c[kept[hot]] for c in columns]), OPEN)


def _pass(rows: DataFrame, name: str) -> DataFrame:
    """kind, doc, at, o, n: the repeats, and the runs that are still open after this digit."""
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sent = None, False       # the last kept run of the open bucket, and if it went on
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            columns = [batch.column(c).to_numpy() for c in NAMES[:6]]
            through = kinds != CANDIDATE
            if through.any():
                yield out(kinds[through], [c[through] for c in columns])
            columns = [c[~through] for c in columns]
            if not len(columns[0]):
                continue
            if before is not None:
                columns = [np.concatenate([b, c]) for b, c in zip(before, columns)]
            key, content = columns[:2]
            bucket = np.ones(len(key), bool)
            bucket[1:] = key[1:] != key[:-1]
            kept = bucket.copy()
            kept[1:] |= content[1:] != content[:-1]
            source = np.maximum.accumulate(np.where(kept, np.arange(len(key)), 0))
            again = ((columns[2] != columns[2][source])      # one place twice is no repeat
                     | (columns[3] != columns[3][source]))
            group = np.cumsum(bucket) - 1
            different = np.bincount(group, kept)
            different[0] += sent
            open_ = kept & (different[group] > 1)
            open_[0] &= not sent
            yield out(np.full(again.sum(), REPEAT), [c[again] for c in columns])
            yield out(np.full(open_.sum(), OPEN), [c[open_] for c in columns])
            last = np.flatnonzero(kept)[-1]
            before, sent = [c[last:last + 1] for c in columns], different[group[last]] > 1

    def out(kinds: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds.astype(np.int32)), *(pa.array(c) for c in columns[2:])],
            names=["kind", "doc", "at", "o", "n"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "content", "doc", "at")
    return written(dealt.mapInArrow(decide, "kind int, doc long, at long, o int, n int"), name)


def _windows(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """Digit one: the runs of every text by their anchors."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        up, down = byte_hash.tables(2 * PIECE)
        held, count = [], 0
        for batch in batches:
            for low, high in pieces(batch, "text", PIECE):
                data = text_bytes(batch, "text", low, high)
                offsets = text_offsets(batch, "text")[low:high + 1]
                offsets = offsets - offsets[0]
                doc, high32 = (batch.column(c).to_numpy()[low:high] for c in ("doc", "hash32"))
                # a longer text is scanned in parts that overlap by less than a window
                for cut in range(0, max(len(data) - threshold + 1, 0), PIECE):
                    part = data[cut:cut + PIECE + threshold - 1] if high == low + 1 else data
                    ends = np.array([0, len(part)]) if high == low + 1 else offsets
                    row, start, *rest = runs(part, ends, up, down)
                    at = (high32[row] << START) + (start - ends[row] + cut)
                    held.append([rest[0], rest[1], doc[row], at, rest[2], rest[3]])
                    count += len(row)
                    if high > low + 1:
                        break
                if count >= HELD:
                    yield from decided_here(held, threshold)
                    held, count = [], 0
        if count:
            yield from decided_here(held, threshold)

    def runs(data: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray):
        """Row, start, key, content, offset of the anchor in the first window, and windows."""
        hashes = byte_hash.grams(data, gram)
        order = (hashes >> np.uint64(LOW) << np.uint64(LOW)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (byte_hash.sliding_min(order, threshold - gram + 1)
                  & np.uint64((1 << LOW) - 1)).astype(np.int64)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        n = len(anchor)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
        inside = row[:n] == row[threshold - 1:threshold - 1 + n]
        new = np.ones(n, bool)
        new[1:] = ((anchor[1:] != anchor[:-1]) | (row[1:n] != row[:n - 1])
                   | (inside[1:] != inside[:-1]))
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, n))
        start, length = start[inside[start]], length[inside[start]]
        spans = byte_hash.Intervals(data, 7, up, down)
        at = anchor[start]
        shape = (at - start) * 4096 + length
        content = byte_hash.mixed(spans(start, start + length - 1 + threshold)
                                  + shape.astype(np.uint64) * np.uint64(byte_hash.ODD))
        return row[start], start, hashes[at], content, at - start, length

    return docs.mapInArrow(scan, ROW_DDL)


def _bytes_of(docs: DataFrame, open_: DataFrame, threshold: int) -> DataFrame:
    """doc, at, o, n, bytes: the open runs with the bytes of their windows."""
    lists = open_.groupBy("doc", F.shiftright("at", START).alias("hash32")).agg(
        F.collect_list(F.struct("at", "o", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = memoryview(batch.column("text")[row].as_buffer())
                doc = batch.column("doc")[row].as_py()
                found = batch.column("runs")[row].as_py()
                starts = [r["at"] & ((1 << START) - 1) for r in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(found), pa.int64()),
                     pa.array([r["at"] for r in found], pa.int64()),
                     pa.array([r["o"] for r in found], pa.int32()),
                     pa.array([r["n"] for r in found], pa.int32()),
                     pa.array([bytes(data[s:s + r["n"] + threshold - 1])
                               for s, r in zip(starts, found)], pa.binary())],
                    names=["doc", "at", "o", "n", "bytes"])

    return docs.join(lists.hint("shuffle_hash"), ["doc", "hash32"]).select(
        "doc", "text", "runs").mapInArrow(cut, "doc long, at long, o int, n int, bytes binary")


def _cells(spans: DataFrame, threshold: int, cell: int, name: str) -> DataFrame:
    """A pass over cells of `cell` windows, on a grid laid from the anchor, of runs with bytes.
    With cell 1 key and content are two hashes of the window."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, count = [], 0
        for batch in batches:
            for low, high in pieces(batch, "bytes", PIECE):
                data = text_bytes(batch, "bytes", low, high)
                begin = text_offsets(batch, "bytes")[low:high]
                begin = begin - begin[0]
                doc, at, o, n = (batch.column(c).to_numpy()[low:high].astype(np.int64)
                                 for c in ("doc", "at", "o", "n"))
                up, down = byte_hash.tables(len(data))
                # cell c holds the windows whose anchor offset is in [c * cell, (c + 1) * cell)
                top, least = o // cell, (o - n + 1) // cell
                row = np.repeat(np.arange(len(doc)), top - least + 1)
                place = np.arange(len(row)) - np.repeat(
                    np.cumsum(top - least + 1) - (top - least + 1), top - least + 1)
                c = top[row] - place
                high_o = np.minimum(o[row], c * cell + cell - 1)
                low_o = np.maximum(o[row] - n[row] + 1, c * cell)
                start = begin[row] + o[row] - high_o           # of the cell's first window
                windows = high_o - low_o + 1
                core = begin[row] + o[row] - c * cell          # of the window with the least offset
                one = byte_hash.Intervals(data, 11, up, down)
                two = byte_hash.Intervals(data, 13, up, down)
                end = start + windows - 1 + threshold
                shape = (c * 4096 + (high_o - c * cell) * 64 + windows).astype(np.uint64)
                if cell == 1:
                    key, content = one(start, end), two(start, end)
                else:
                    key = byte_hash.mixed(one(core, core + threshold - cell + 1)
                                          + c.astype(np.uint64) * np.uint64(byte_hash.ODD))
                    content = byte_hash.mixed(two(start, end) + shape * np.uint64(byte_hash.ODD))
                held.append([key, content, doc[row], at[row] + o[row] - high_o, high_o, windows])
                count += len(row)
                if count >= HELD:
                    yield from decided_here(held, threshold)
                    held, count = [], 0
        if count:
            yield from decided_here(held, threshold)

    return _pass(spans.mapInArrow(split, ROW_DDL), name)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, hash32, text: rows with the same id and text are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.pmod(F.xxhash64(text), F.lit(1 << 32)).alias("hash32"), text.alias("text"))


def repeated_ranges(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """doc, hash32, ranges: for each document with repeats, its byte ranges (start, end) that lie
    in a window which starts earlier in the corpus; unordered, they may overlap."""
    texts = keyed(docs)
    texts = texts.filter(F.octet_length("text") >= threshold)
    first = _pass(_windows(texts, threshold, gram), "repeats-one")
    spans = written(_bytes_of(texts, first.filter(F.col("kind") == OPEN).drop("kind").distinct(),
                              threshold), "repeats-bytes")
    second = _cells(spans, threshold, CELL, "repeats-two")
    # the bytes of an open cell are cut out of those of its run, which has the same anchor
    run = spans.select("doc", (F.col("at") + F.col("o")).alias("anchor"), F.col("at").alias("from"),
                       F.col("n").alias("many"), "bytes")
    cells = second.filter(F.col("kind") == OPEN).drop("kind").distinct().withColumn(
        "anchor", F.col("at") + F.col("o"))
    within = cells.join(run, ["doc", "anchor"]).filter("at >= from and at + n <= from + many")
    last = within.select("doc", "at", "o", "n", F.expr(
        f"substring(bytes, cast(at - from as int) + 1, n + {threshold - 1})").alias("bytes"))
    third = _cells(last, threshold, 1, "repeats-three")
    found = first.unionByName(second).unionByName(third).filter(F.col("kind") == REPEAT)
    start = F.col("at").bitwiseAND((1 << START) - 1)
    return found.groupBy("doc", F.shiftright("at", START).alias("hash32")).agg(F.collect_list(
        F.struct(start.alias("start"), (start + F.col("n") + (threshold - 1)).alias("end")))
        .alias("ranges"))


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM,
                   with_text: bool = False) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans and kept_sha256 (and, with_text, text:
    the kept bytes, less any character that lost a byte).

    A byte goes if some `threshold` bytes that cover it also start earlier: in a smaller doc_id or
    earlier in the same document; all texts are judged as they came in. Null or empty text: no
    bytes. A null doc_id comes first. Rows with one id and one text are one document and get one
    answer; one id with different texts is several documents, in the order of a hash of the text (of
    32 bits: two texts under one id that agree in them are not told apart).
    Texts shorter than the threshold stay; very long ones are scanned in overlapping parts. An
    empty table stays empty. Other columns pass through, but for those added, which are replaced.
    """
    from pyspark.sql import types as T

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    added += [T.StructField("text", T.StringType())] if with_text else []
    new = {f.name for f in added} | {"text"}
    others = [f for f in docs.schema if f.name not in new]
    names = [f.name for f in others]
    ranges = repeated_ranges(docs, threshold, gram).select(
        F.col("doc").alias("__of"), F.col("hash32").alias("__of32"),
        F.col("ranges.start").alias("__starts"), F.col("ranges.end").alias("__ends"))
    text = F.coalesce(F.col("text"), F.lit(""))
    ours = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"),
                       F.pmod(F.xxhash64(text), F.lit(1 << 32)).alias("__32"),
                       text.alias("__text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch, "__text", 2 * PIECE):
                part = batch.slice(low, high - low)
                out = [one(*row) for row in zip(part.column("__text"), part.column("__starts"),
                                                part.column("__ends"))]
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names]
                    + [pa.array(c, k) for c, k in zip(columns, kinds)][:len(added)],
                    names=names + [f.name for f in added])

    def one(text: pa.Scalar, starts: pa.Scalar, ends: pa.Scalar) -> tuple:
        data = memoryview(text.as_buffer())
        kept, removed, at, spans = [], 0, 0, 0
        end = -1
        for low, high in sorted(zip(starts.as_py() or [], ends.as_py() or [])):
            if low > end:
                kept.append(data[at:low])
                spans += 1
                removed += high - low
            elif high > end:
                removed += high - end
            end = max(end, high)
            at = end
        kept.append(data[at:])
        digest = hashlib.sha256()
        for piece in kept:
            digest.update(piece)
        rest = b"".join(kept).decode("utf-8", "ignore") if with_text else None
        return len(data), removed, spans, digest.hexdigest(), rest

    joined = ours.join(ranges.hint("shuffle_hash"), (F.col("__doc") == F.col("__of"))
                       & (F.col("__32") == F.col("__of32")), "left")
    return joined.select(*names, "__text", "__starts", "__ends").mapInArrow(
        cut, T.StructType([*others, *added]))
