"""Word passages that occur in an earlier document, found on a de Bruijn graph of the corpus.

The `window` words from a position on are an edge of the graph, between the nodes of its first and
its last `window` - 1 words; an edge that starts in two documents is repeated. A corpus is not blown
up to a row an edge:

* Edges are dealt by their minimiser, the `gram` words with the least hash in them. Neighbours
  mostly share theirs, so a run of edges travels as one row, its content a hash of all its words.
  A bucket in which only one content occurs is a path without branches: its edges are repeated all
  or none, and are decided at once. Only where contents differ, the graph may branch within the
  run: one source of each content goes on, as single edges under 128 bits of hash.
* What repeats is a piece of a path, with the coordinates of its source: the least document that
  has the same words. Pieces that meet end to end, in the text and in its source, meet in a node
  with one way in and one way out. Counting the ways of all nodes leaves the ends of maximal paths,
  and a join of first and last nodes makes spans of them.
* The words at the source's coordinates verify each span before anything is removed.

Tasks decide what they can before the shuffle: of copies in one task only the first sends rows on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import byte_hash
from tickloom.llm.common import forget, pieces, text_bytes, text_offsets, written
from tickloom.llm.word_scan import WordSpans, long_text, words_of

WINDOW, GRAM = 13, 6
PIECE = 1 << 20            # bytes scanned at once; word positions in it fit the low bits
LOW = 22
HELD = 1 << 20             # rows that a task decides together before it sends them on
WAITING = 1 << 16          # rows of one content that wait for a second content of their bucket
NO_ID = -(1 << 63)
EDGES, PIECES, OPEN = 0, 1, 2
NUMBERS = ["key", "content", "doc", "part", "at", "n"]
SOURCE = ["src_doc", "src_part", "src_at"]
ROW_DDL = ", ".join(f"{c} long" for c in [*NUMBERS, *SOURCE]) + ", kind int"


def _batch(kind: int, columns: list[np.ndarray], source: list[np.ndarray] | None = None):
    n = len(columns[0])
    source = source or [np.zeros(n, np.int64)] * len(SOURCE)
    arrays = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in [*columns, *source]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(n, kind, np.int32))],
                                      names=[*NUMBERS, *SOURCE, "kind"])


def _spread(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The same rows under keys that deal decided ones evenly."""
    key = byte_hash.mixed(columns[2].view(np.uint64) * np.uint64(byte_hash.ODD)
                          + columns[4].view(np.uint64)).view(np.int64)
    return [key, np.zeros(len(key), np.int64), *columns[2:]]


def _same(columns: list[np.ndarray], *at: int) -> np.ndarray:
    """Whether each row but the first agrees with the one before in the columns `at`."""
    found = np.zeros(len(columns[0]), bool)
    found[1:] = True
    for c in at:
        found[1:] &= columns[c][1:] == columns[c][:-1]
    return found


def _compare(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by all columns: each row's first of the same content; rows of later documents
    than that; rows to keep, which are one for each text under the first's document id."""
    content = _same(columns, 0, 1)
    first = np.maximum.accumulate(np.where(content, 0, np.arange(len(content))))
    later = columns[2] > columns[2][first]
    return first, later, ~later & ~_same(columns, 0, 1, 2, 3)


def _decided_here(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*held)]
    held.clear()
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first, later, keep = _compare(columns)
    yield _batch(PIECES, _spread([c[later] for c in columns]),
                 [columns[c][first[later]] for c in (2, 3, 4)])
    yield _batch(EDGES, [c[keep] for c in columns])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, content, document: pieces with their sources, and open rows."""
    carried, opened = None, False       # kept rows of the last content, and if they went on
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        columns = [batch.column(c).to_numpy() for c in NUMBERS]
        done = kind == PIECES
        if done.any():
            yield _batch(PIECES, [c[done] for c in columns],
                         [batch.column(c).to_numpy()[done] for c in SOURCE])
        columns = [c[~done] for c in columns]
        if not len(columns[0]):
            continue
        old = 0
        if carried is not None:
            old = len(carried[0])
            columns = [np.concatenate(pair) for pair in zip(carried, columns)]
        first, later, keep = _compare(columns)
        if later.any():
            yield _batch(PIECES, [c[later] for c in columns],
                         [columns[c][first[later]] for c in (2, 3, 4)])
        bucket = np.cumsum(~_same(columns, 0)) - 1
        contents = np.bincount(bucket, first == np.arange(len(first)))
        contents[0] += opened
        send = keep & (contents[bucket] > 1)
        send[:old] &= not opened
        tail = keep & (first == first[-1])
        same_bucket = bucket[-1] == 0
        opened = bool(contents[-1] > 1) or (opened and same_bucket)
        if tail.sum() > WAITING and not opened:
            send, opened = send | tail, True
        if opened and tail.sum() > 1:
            tail = np.arange(len(first)) == first[-1]
        if send.any():
            yield _batch(OPEN, [c[send] for c in columns])
        carried = [c[tail] for c in columns]


def _pass(rows: DataFrame, name: str) -> DataFrame:
    dealt = rows.repartition("key").sortWithinPartitions(*NUMBERS)
    return written(dealt.mapInArrow(_decide, ROW_DDL).drop("key", "content"), name)


def _texts(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple]:
    """Rows low..high-1 of a batch, their bytes, start, end and row of the words, and the number
    of the first word, of parts of bounded size."""
    for low, high in pieces(batch, "text", PIECE):
        data = text_bytes(batch, "text", low, high)
        if high == low + 1 and len(data) > PIECE:
            for part, start, end, number in long_text(data, PIECE, overlap):
                yield low, high, part, start, end, np.zeros(len(start), np.int64), number
        else:
            offsets = text_offsets(batch, "text")[low:high + 1]
            yield low, high, data, *words_of(data, offsets - offsets[0]), 0


def runs(spans: WordSpans, row: np.ndarray, window: int, gram: int):
    """First word, key, content and number of edges of each run of edges with one minimiser."""
    n = len(row) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    place = np.arange(len(row) - gram + 1)
    hashes = spans(place, place + gram)
    low = np.uint64((1 << LOW) - 1)
    least = byte_hash.sliding_min((hashes & ~low) | place.astype(np.uint64), window - gram + 1)
    anchor = (least[:n] & low).astype(np.int64)
    inside = row[:n] == row[window - 1:]
    new = np.ones(n, bool)
    new[1:] = ((anchor[1:] != anchor[:-1]) | (row[1:n] != row[:n - 1])
               | (inside[1:] != inside[:-1]))
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    start, length = start[inside[start]], length[inside[start]]
    shape = (anchor[start] - start) * 4096 + length
    content = byte_hash.mixed(spans(start, start + length - 1 + window)
                              + shape.astype(np.uint64) * np.uint64(byte_hash.ODD))
    return start, hashes[anchor[start]], content, length


def _edges(texts: DataFrame, window: int, gram: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tables = byte_hash.tables(2 * PIECE)
        held, count = [], 0
        for batch in batches:
            doc, part = (batch.column(c).to_numpy() for c in ("doc", "part"))
            for low, high, data, start, end, row, number in _texts(batch, window - 1):
                spans = WordSpans(data, start, end, 17, tables)
                at, key, content, n = runs(spans, row, window, gram)
                of = row[at]
                begin = np.searchsorted(row, of)       # the first word of the same text
                held.append([key.view(np.int64), content.view(np.int64), doc[low:high][of],
                             part[low:high][of], at - begin + number, n])
                count += len(at)
                if count >= HELD:
                    yield from _decided_here(held)
                    count = 0
        if count:
            yield from _decided_here(held)

    return texts.mapInArrow(scan, ROW_DDL)


def _single_edges(texts: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """The edges of open runs, under two hashes of their words."""
    lists = open_.groupBy("doc", "part").agg(
        F.collect_list(F.struct("at", "n")).alias("runs")).select(
        "doc", "part", F.col("runs.at").alias("ats"), F.col("runs.n").alias("ns"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tables = byte_hash.tables(2 * PIECE)
        held, count = [], 0
        for batch in batches:
            doc, part = (batch.column(c).to_numpy() for c in ("doc", "part"))
            for low, high, data, start, end, row, number in _texts(batch, window - 1):
                one, two = (WordSpans(data, start, end, seed, tables) for seed in (19, 23))
                begin = np.searchsorted(row, np.arange(high - low + 1))
                for r in range(high - low):
                    at, n = (np.array(batch.column(c)[low + r].as_py()) for c in ("ats", "ns"))
                    at = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                    words = begin[r + 1] - begin[r]
                    at = at[(at >= number) & (at <= number + words - window)]
                    place = at - number + begin[r]
                    held.append([one(place, place + window).view(np.int64),
                                 two(place, place + window).view(np.int64),
                                 np.full(len(at), doc[low + r]), np.full(len(at), part[low + r]),
                                 at, np.ones(len(at), np.int64)])
                    count += len(at)
                if count >= HELD:
                    yield from _decided_here(held)
                    count = 0
        if count:
            yield from _decided_here(held)

    joined = texts.join(lists.hint("shuffle_hash"), ["doc", "part"])
    return joined.select("doc", "part", "text", "ats", "ns").mapInArrow(split, ROW_DDL)


def _compacted(found: DataFrame) -> DataFrame:
    """Pieces of paths that meet end to end as spans: doc, part, at, n and the source's."""
    line = ["doc", "part", "src_doc", "src_part", "shift"]
    nodes = F.explode(F.array(F.struct("at", F.lit(1).alias("way")),
                              F.struct((F.col("at") + F.col("n")).alias("at"),
                                       F.lit(-1).alias("way")))).alias("node")
    ways = found.withColumn("shift", F.col("at") - F.col("src_at")).select(
        *line, nodes).select(*line, "node.*")
    ends = ways.groupBy(*line, "at").agg(F.min("way").alias("low"), F.max("way").alias("way")).filter(
        "low = way").drop("low")       # one way in and one out: the path goes on
    # spans of one line do not overlap, so the n-th first node belongs to the n-th last node
    order = Window.partitionBy(*line, "way").orderBy("at")
    ends = ends.withColumn("rank", F.row_number().over(order))
    last = ends.filter("way < 0").select(*line, "rank", F.col("at").alias("end"))
    return ends.filter("way > 0").join(last, [*line, "rank"]).select(
        "doc", "part", "at", (F.col("end") - F.col("at")).alias("n"), "src_doc", "src_part",
        (F.col("at") - F.col("shift")).alias("src_at"))


def _sources(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """src_doc, src_part, src_at, n, digest: of the words at the coordinates that spans name."""
    asked = spans.select("src_doc", "src_part", "src_at", "n").distinct()
    # lists of bounded length, whatever number of spans has one source
    lists = asked.groupBy("src_doc", "src_part", F.shiftright("src_at", 16).alias("b")).agg(
        F.collect_list(F.struct("src_at", "n")).alias("asked")).select(
        F.col("src_doc").alias("doc"), F.col("src_part").alias("part"), "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words = batch.column("text")[r].as_buffer().to_pybytes().split()
                asked = batch.column("asked")[r].as_py()
                many = len(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("doc")[r].as_py()] * many, pa.int64()),
                     pa.array([batch.column("part")[r].as_py()] * many, pa.int64()),
                     pa.array([a["src_at"] for a in asked], pa.int64()),
                     pa.array([a["n"] for a in asked], pa.int64()),
                     pa.array([digest(words, a["src_at"], a["n"] + window - 1) for a in asked],
                              pa.binary())],
                    names=["src_doc", "src_part", "src_at", "n", "digest"])

    joined = texts.join(lists.hint("shuffle_hash"), ["doc", "part"])
    return joined.select("doc", "part", "text", "asked").mapInArrow(
        read, "src_doc long, src_part long, src_at long, n long, digest binary")


def digest(words: list[bytes], at: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[at:at + n]), digest_size=16).digest()


def keyed(docs: DataFrame) -> list:
    """Columns doc, part, text: rows with one id and one text are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
            F.xxhash64(text).alias("part"), text.alias("text")]


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, part, at, n, digest and the source's src_doc, src_part, src_at: maximal stretches of n
    edges from word `at` on whose words also stand, in order, from word src_at of an earlier
    document on. A place that a document repeats within itself is named at least once."""
    texts = docs.select(*keyed(docs)).filter(F.octet_length("text") >= 2 * window - 1)
    first = _pass(_edges(texts, window, gram), "debruijn-runs")
    open_ = first.filter(F.col("kind") == OPEN).select("doc", "part", "at", "n")
    second = _pass(_single_edges(texts, open_, window), "debruijn-edges")
    both = first.unionByName(second).filter(F.col("kind") == PIECES).drop("kind")
    spans = written(_compacted(both), "debruijn-spans")
    return spans.join(_sources(texts, spans, window), ["src_doc", "src_part", "src_at", "n"])


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                    with_text: bool = False) -> DataFrame:
    """docs without text, with n_words, n_removed and kept_sha256 (and, with_text, text: the kept
    words joined by single spaces).

    A word goes if some `window` words of its document that cover it also start in a document with
    a smaller doc_id; all texts are judged as they came in. Null, empty or blank text: no words. A
    null doc_id comes first. Rows under one id do not repeat one another; with one text they get one
    answer. Texts of fewer words than the window stay; very long ones are scanned in overlapping
    parts. Spans whose source does not verify (a hash collision) stay. An empty table stays empty.
    Other columns pass through, but for those added, which are replaced.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("kept_sha256", T.StringType())]
    added += [T.StructField("text", T.StringType())] if with_text else []
    new = {f.name for f in added} | {"text"}
    others = [f for f in docs.schema if f.name not in new]
    names = [f.name for f in others]
    lists = repeated_spans(docs, window, gram).groupBy("doc", "part").agg(
        F.collect_list(F.struct("at", "n", "digest")).alias("spans")).select(
        F.col("doc").alias("__of"), F.col("part").alias("__of_part"), F.col("spans").alias("__spans"))
    doc, part, text = keyed(docs)
    ours = docs.select(*names, doc.alias("__doc"), part.alias("__part"), text.alias("__text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch, "__text", PIECE):
                part = batch.slice(low, high - low)
                out = list(zip(*[kept(*row) for row in zip(part.column("__text"),
                                                           part.column("__spans"))]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names]
                    + [pa.array(c, k) for c, k in zip(out, kinds)][:len(added)],
                    names=names + [f.name for f in added])

    def kept(text: pa.Scalar, spans: pa.Scalar) -> tuple:
        data = text.as_buffer().to_pybytes()
        words = data.split()
        edges = np.zeros(max(len(words) - window + 1, 0), bool)
        for span in spans.as_py() or []:
            if digest(words, span["at"], span["n"] + window - 1) == span["digest"]:
                edges[span["at"]:span["at"] + span["n"]] = True
        rest = words
        if edges.any():
            if not edges.all():
                edges |= _alike(words, edges)
            gone = np.zeros(len(words) + 1, np.int64)
            gone[:len(edges)] += edges
            gone[window:len(edges) + window] -= edges
            rest = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        joined = b" ".join(rest)
        return (len(words), len(words) - len(rest), hashlib.sha256(joined).hexdigest(),
                joined.decode() if with_text else None)

    def _alike(words: list[bytes], edges: np.ndarray) -> np.ndarray:
        """Edges with the words of a marked edge of the same text."""
        ids: dict[bytes, int] = {}
        number = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
        up, down = byte_hash.tables(len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(byte_hash.mixed(number + np.uint64(byte_hash.ODD)) * up[:len(words)], out=sums[1:])
        at = np.arange(len(edges))
        hashes = byte_hash.mixed((sums[at + window] - sums[at]) * down[at])
        return np.isin(hashes, hashes[edges])

    joined = ours.join(lists.hint("shuffle_hash"), (F.col("__doc") == F.col("__of"))
                       & (F.col("__part") == F.col("__of_part")), "left")
    return joined.select(*names, "__text", "__spans").mapInArrow(
        cut, T.StructType([*others, *added]))
