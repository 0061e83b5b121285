"""Language identification in two steps: the family first, then the language within it.

Texts become the relative frequencies of hashed byte trigrams of the whole lower-cased text. A
one-versus-rest linear support vector machine picks the family; within it, one machine for each
pair of languages votes, margins breaking ties. All machines are fitted on the driver by Newton
steps on the squared hinge, on a sample of labelled texts of a bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import forget, local, pieces, text_bytes, text_offsets, text_or_empty

UNKNOWN = "und"
BUCKETS, PER_LANGUAGE = 2048, 400
#: Families of ISO 639-1 codes; a language without one is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"), "semitic": ("ar", "he", "fa"),
}
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """weights have a row for each machine: families against the rest, then pairs of languages."""
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS + 1), np.float32))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the trigram frequencies of each text, and a constant."""
    rows = len(offsets) - 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    lower[(lower < 33) | ((lower >= 48) & (lower < 58))] = 32        # blanks and digits alike
    out = np.zeros((rows, BUCKETS + 1), np.float32)
    if len(lower) >= 3:
        code = (lower[:-2] << 16) | (lower[1:-1] << 8) | lower[2:]
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
        row = np.repeat(np.arange(rows), np.diff(offsets))[:-2]
        inside = row == np.repeat(np.arange(rows), np.diff(offsets))[2:]
        flat = np.bincount(row[inside] * BUCKETS + bucket[inside], minlength=rows * BUCKETS)
        out[:, :BUCKETS] = flat.reshape(rows, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(out[:, :BUCKETS] / np.maximum(out.sum(1, keepdims=True), 1))
    out[:, BUCKETS] = 1
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 20) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; classes weigh alike. y is +1 or -1."""
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    each = cost * len(y) * each
    if len(y) > x.shape[1]:
        return _by_weights(x, y, each, steps)
    gram = x @ x.T                      # the solution is a sum of examples: w = x' a
    a, active = np.zeros(len(y)), np.ones(len(y), bool)
    for _ in range(steps):
        own = np.flatnonzero(active)
        a = np.zeros(len(y))
        a[own] = np.linalg.solve(gram[np.ix_(own, own)] + np.diag(1 / each[own]), y[own])
        now = y * (gram @ a) < 1
        if (now == active).all():
            break
        active = now
    w = x.T @ a
    return w.astype(np.float32)


def _by_weights(x: np.ndarray, y: np.ndarray, each: np.ndarray, steps: int) -> np.ndarray:
    """The same machine from more texts than features: a system of the features' size, summed up
    over parts of the texts."""
    size, active = x.shape[1], np.ones(len(y), bool)
    w = np.zeros(size)
    for _ in range(steps):
        left, right = np.eye(size), np.zeros(size)
        for at in range(0, len(y), size):
            own = at + np.flatnonzero(active[at:at + size])
            some = x[own].astype(np.float64)
            weighed = some * each[own, None]
            left += some.T @ weighed
            right += weighed.T @ y[own]
        w = np.linalg.solve(left, right)
        now = y * (x @ w.astype(x.dtype)) < 1
        if (now == active).all():
            break
        active = now
    return w.astype(np.float32)


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE,
        id_col: str = "doc_id") -> Model:
    """Learns from the rows of docs where `learn` holds and lang is not null, at most
    `per_language` texts a language, those with the least hash of text and id; repeated rows count
    once. Tasks turn whole texts into features, so the driver gets `per_language` vectors a
    language and no text, however long.
    """
    rank = F.xxhash64(F.col("text"), F.col(id_col))
    wanted = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()
                         & F.col("text").rlike(r"\p{L}"))
    keyed = wanted.select("lang", rank.alias("rank"))
    # one bounded list a language, kept small in every task by the threshold of its count
    n = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(
        F.approx_count_distinct("rank", 0.02).alias("n")).collect()}
    if not n:
        return Model()
    spark = docs.sparkSession
    limits = local(
        spark, [(lang, min((1 << 64) - 1, (1 << 64) * per_language * 13 // (10 * count)) - (1 << 63))
         for lang, count in n.items()], pa.schema([("learnt", pa.string()), ("most", pa.int64())]))
    rows = (wanted.select("lang", "text", rank.alias("rank"))
            .join(limits, F.col("lang") == F.col("learnt")).filter("rank <= most")
            .select("lang", "rank", "text").mapInArrow(vectors, "lang string, rank long, x binary")
            .dropDuplicates(["lang", "rank"]).collect())
    rows = sorted(rows, key=lambda r: (r["lang"], r["rank"]))
    rows = [r for _, g in itertools.groupby(rows, key=lambda r: r["lang"])
            for r in itertools.islice(g, per_language)]
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    return learnt(x, [r["lang"] for r in rows])


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, rank and the features of each whole text."""
    forget()
    for batch in batches:
        for low, high in pieces(batch, "text", 1 << 20):
            some = batch.slice(low, high - low)
            offsets = text_offsets(batch, "text")[low:high + 1]
            x = features(text_bytes(batch, "text", low, high), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays(
                [some.column("lang"), some.column("rank"),
                 pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "rank", "x"])


def learnt(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    y = np.array([languages.index(label) for label in labels])
    of = {code: name for name, codes in FAMILIES.items() for code in codes}
    groups: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        groups.setdefault(of.get(lang, "/" + lang), []).append(i)
    families = list(groups.values())
    if len(x) <= x.shape[1]:
        x = x.astype(np.float64)
    weights, pairs = [], []
    if len(families) > 1:
        weights += [svm(x, np.where(np.isin(y, group), 1.0, -1.0)) for group in families]
    for group in families:
        for a, b in itertools.combinations(group, 2):
            rows = np.isin(y, (a, b))
            pairs.append((a, b))
            weights.append(svm(x[rows], np.where(y[rows] == a, 1.0, -1.0)))
    table = np.array(weights, np.float32) if weights else np.zeros((0, x.shape[1]), np.float32)
    return Model(languages, families, pairs, table)


def classify(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each row, and a score from 0 to 1."""
    margin = x @ model.weights.T
    n = len(model.families) if len(model.families) > 1 else 0
    family = margin[:, :n].argmax(1) if n else np.zeros(len(x), np.int64)
    score = _squash(margin[np.arange(len(x)), family]) if n else np.ones(len(x))
    chosen = np.array([group[0] for group in model.families])[family]
    votes, strength = np.zeros((2, len(x), len(model.languages)))
    for (a, b), m in zip(model.pairs, margin[:, n:].T):
        votes[:, a] += m > 0
        votes[:, b] += m <= 0
        strength[:, a] += _squash(m)
        strength[:, b] += _squash(-m)
    for f, group in enumerate(model.families):
        if len(group) > 1:
            rows = np.flatnonzero(family == f)
            total = votes[np.ix_(rows, group)] + strength[np.ix_(rows, group)] / len(group)
            best = np.array(group)[total.argmax(1)]
            chosen[rows] = best
            score[rows] *= strength[rows, best] / (len(group) - 1)
    return chosen, score


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin.astype(np.float64), -30, 30)))


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            keep_text: bool = True) -> DataFrame:
    """docs (without the text unless keep_text) with lang_pred and score. Only the text is judged,
    whole.

    Null or empty text and text without a letter: und, score 0; so is all if nothing was learnt.
    Repeated rows are answered alike; an empty table stays empty. Other columns pass through, but
    for lang_pred and score, which are replaced.
    """
    new = ("lang_pred", "score") if keep_text else ("lang_pred", "score", text_col)
    others = [f for f in docs.schema if f.name not in new]
    names = [f.name for f in others]
    # machines x buckets: bounded; plain values, so that workers need no class to read them
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.families, model.pairs, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = Model(*shared.value)
        for batch in batches:
            for low, high in pieces(batch, "__text", 1 << 20):
                some = batch.slice(low, high - low)
                data = text_bytes(batch, "__text", low, high)
                offsets = text_offsets(batch, "__text")[low:high + 1]
                texts = some.column("__text")
                known = np.array([bool(LETTER.search(t)) for t in texts.to_pylist()])
                lang, score = np.full(high - low, UNKNOWN, object), np.zeros(high - low)
                if model.languages and known.any():
                    best, own = classify(model, features(data, offsets - offsets[0]))
                    lang = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                    score = np.where(known, own, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [some.column(n) for n in names]
                    + [pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())],
                    names=[*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*others, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return docs.select(*names, text_or_empty(text_col).alias("__text")).mapInArrow(run, schema)
