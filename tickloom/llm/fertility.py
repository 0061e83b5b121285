"""Quality rules: plain counts, and how public vocabularies split a text.

A vocabulary spends few tokens on text like that it was made from. Figures of the whole text's
encoding are held against two kinds of bands. Fixed ones by script, wide, for the first vocabulary:
characters per token, the share of tokens that are lone fallback bytes, and the entropy of the
text's tokens over the most that so many tokens could have. Hashes, encoded data and text in a
wrong character set lie outside.

And measured ones: the quartiles of the corpus's own documents of the same script, language and
size give fences (1.5 times their distance beyond them) for characters per token, tokens per word
and entropy; sizes with few texts are held against their whole language but for the entropy, which
falls with length. A text beyond the fence of one figure in every vocabulary is an outlier; what only one
vocabulary finds odd is not. No labels are used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import kept, pieces, text_or_empty, written
from tickloom.llm.encoding import LARGE, Cut, byte_level
from tickloom.llm.piece_codec import BYTE, PieceCodec

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, FEWEST, REPEATED = 8, 20, 30      # words a window; fewest words; per cent of them repeated
#: Fences lie so many quartile distances beyond the quartiles; the distance counts as a share of the
#: median at least, so that near copies don't close them; groups of fewer texts have none.
FENCE, NARROWEST, GROUP = 1.5, 0.02, 50
KEYS = ["script", "lang", "size"]       # size: binary digits of the number of words


@dataclass(frozen=True)
class Band:
    """What a text may show; least_entropy is a share of the most possible."""
    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: By the script of most letters. Scripts that the vocabulary hardly knows fall back to bytes by
#: nature, about three a character, so their bands leave that alone.
BANDS = {
    "latin": Band(1.3, 12.0, 0.25, 0.35),
    "cyrillic": Band(0.9, 12.0, 0.35, 0.35),
    "greek": Band(0.6, 12.0, 0.60, 0.30),
    "cjk": Band(0.25, 6.0, 0.95, 0.30),
    "other": Band(0.2, 12.0, 1.0, 0.25),
    "none": Band(0.5, 12.0, 0.25, 0.35),
}
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
           ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("cjk", 0xAC00, 0xD7AF))


def script(text: str) -> str:
    """The script of most of a text's letters; none without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.max() < 1 << 14:              # counted, not sorted
        counts = np.bincount(points)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        codes, counts = np.unique(points, return_counts=True)
    found: Counter = Counter()
    for code, n in zip(codes.tolist(), counts.tolist()):
        if chr(code).isalpha():
            found[next((s for s, low, high in SCRIPTS if low <= code <= high), "other")] += n
    return max(sorted(found), key=found.__getitem__) if found else "none"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of 8 words that occurs twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    total, width = hashes, 1
    while width < WINDOW:                       # WINDOW is a power of two
        base = np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        total = total[:-width] * base + total[width:]
        width *= 2
    ordered = np.sort(total)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(total)
    same = total[order][1:] == total[order][:-1]
    starts = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    one, other = order[1:][same], order[:-1][same]
    if not all((hashes[one + i] == hashes[other + i]).all() for i in range(WINDOW)):
        # different windows under one total: only those found again word by word count
        seen = Counter(tuple(words[s:s + WINDOW]) for s in starts.tolist())
        starts = np.array([s for s in starts.tolist() if seen[tuple(words[s:s + WINDOW])] > 1],
                          np.int64)
    covered = np.zeros(len(words) + 1, np.int64)
    covered[starts] += 1                    # each start occurs once
    covered[starts + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()   # at ASCII white space only
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    return (len(words), chars, sum(text.count(c) for c in SYMBOLS),
            sum(n - 1 for n in lines.values()), repeated_words(words))


def fertility(ids: np.ndarray, text: str,
              is_byte: np.ndarray | None) -> tuple[float, float, float]:
    """Characters per token, share of byte tokens, entropy over the most possible; without is_byte
    the share is 0 and the vocabulary as large as the text needs."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    kind = np.uint16 if ids.max() < 1 << 16 else np.uint32       # short numbers sort by digits
    ordered = np.sort(ids.astype(kind), kind="stable")
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1])
    share = np.diff(np.concatenate([[-1], cuts, [n - 1]])) / n
    entropy = float(-(share * np.log2(share)).sum())
    most = math.log2(n if is_byte is None else min(n, len(is_byte)))
    return (len(text) / n, 0.0 if is_byte is None else int(np.count_nonzero(is_byte[ids])) / n,
            entropy / most if most else 1.0)


def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to token ids by a vocabulary file: a sentencepiece model or a tokenizers file."""
    if path.endswith(".model"):
        return PieceCodec(path, verify=False)
    try:
        return byte_level(path, LARGE)
    except ValueError:                      # files with a normaliser of their own
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda texts: [np.array(e.ids, "<u4")
                              for e in whole.encode_batch(texts, add_special_tokens=False)]


def encoded(encode: Callable[[list[str]], list[np.ndarray]], texts: list[str], rows: list[int],
            cut: Cut) -> dict[int, np.ndarray]:
    """By row, the ids of those texts: from their chunks where they are cut, else from the whole."""
    found = {} if getattr(encode, "uncut", None) is None else encode.of_cut(cut, rows)
    rest = [i for i in rows if i not in found]
    return found | dict(zip(rest, encode([texts[i] for i in rest])))


def fences(figures: DataFrame, measured: list[str], keys: list[str], mark: str) -> DataFrame:
    """Per group the lowest and highest value of each measured figure, as figure_low and
    figure_high after the mark, from the texts that pass the base rules; equal texts count once.
    Quartiles are those of figures rounded to 0.001: exact, the same in every run, and of bounded
    size."""
    base = figures.filter("not base_failed").select(
        *KEYS, "n_words", "word_chars", *measured).distinct()
    found = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"), *[
        F.percentile(F.round(c, 3), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(c)
        for c in measured]).filter(F.col("texts") >= GROUP)
    out = []
    for c in measured:
        far = FENCE * F.greatest(F.col(c)[2] - F.col(c)[0], NARROWEST * F.col(c)[1])
        out += [(F.col(c)[0] - far).alias(f"{mark}{c}_low"), (F.col(c)[2] + far).alias(f"{mark}{c}_high")]
    return found.select(*keys, *out)


def judge(docs: DataFrame, model_path: str | Sequence[str], bands: dict[str, Band] | None = None,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document the counts, base_failed, script, chars_per_token, byte_share, entropy_share,
    tokens_per_word (all by the first of the vocabularies), outlier (beyond the corpus's fences of a
    figure in every vocabulary) and kept (the base holds, the figures lie in the script's band, and
    it is no outlier).

    The fixed bands need a sentencepiece model as the first vocabulary; more are any that encoder()
    reads. A corpus without lang_col is measured by script and size alone.

    Null or empty text: no words, so base_failed. Repeated rows, null ids: each row is judged by
    itself. Very long texts are judged whole. An empty table gives no rows; other columns are not
    read. The figures, without the texts, are written once to the shared folder.
    """
    bands = bands or BANDS
    paths = [model_path] if isinstance(model_path, str) else list(model_path)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), lang.alias("lang"),
                       text_or_empty(text_col).alias("text"))
    names = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
             ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
             ("base_failed", pa.bool_()), ("script", pa.string()), ("chars_per_token", pa.float64()),
             ("byte_share", pa.float64()), ("entropy_share", pa.float64()),
             ("tokens_per_word", pa.float64()), ("in_band", pa.bool_()), ("size", pa.int64())]
    more = [[f"{c}_{i}" for c in ("chars_per_token", "tokens_per_word", "entropy_share")]
            for i in range(1, len(paths))]
    names += [(c, pa.float64()) for some in more for c in some] + [("lang", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(f"plain:{paths[0]}", lambda: PieceCodec(paths[0], verify=False))
        others = [kept(f"plain:{p}", lambda p=p: encoder(p)) for p in paths[1:]]
        uncut = [e.uncut for e in (codec, *others) if getattr(e, "uncut", None)]
        is_byte = np.array([kind == BYTE for *_, kind in codec.model.pieces])
        for batch in batches:
            for low, high in pieces(batch, "text", 1 << 22):
                some = batch.slice(low, high - low)
                texts = some.column("text").to_pylist()
                plains = [counts(text) for text in texts]
                fails = [p[0] < FEWEST or 100 * p[4] > REPEATED * p[0] for p in plains]
                # what fails the base rules stands in no fence: one vocabulary will do
                judged = [i for i, failed in enumerate(fails) if not failed]
                cut = Cut(some.column("text"), uncut)
                ids_of = encoded(codec, texts, list(range(len(texts))), cut)
                theirs_of = [encoded(encode, texts, judged, cut) for encode in others]
                out = []
                for i, (doc_id, lang, text, plain, failed) in enumerate(zip(
                        some.column("doc_id").to_pylist(), some.column("lang").to_pylist(), texts,
                        plains, fails)):
                    ids = ids_of[i]
                    figures, kind = fertility(ids, text, is_byte), script(text)
                    band = bands.get(kind, bands["other"])
                    good = (band.least_chars <= figures[0] <= band.most_chars
                            and figures[1] <= band.most_bytes and figures[2] >= band.least_entropy)
                    words = max(plain[0], 1)
                    extra: list[float | None] = []
                    for theirs in theirs_of:
                        if failed:
                            extra += [None] * 3
                            continue
                        own = theirs[i]
                        chars, _, entropy = fertility(own, text, None)
                        extra += [chars, len(own) / words, entropy]
                    out.append((doc_id, *plain, failed, kind, *figures, len(ids) / words, good,
                                plain[0].bit_length(), *extra, lang))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(columns, names)], schema=pa.schema(names))

    extra = "".join(f"{c} double, " for some in more for c in some)
    figures = written(rows.mapInArrow(run, (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, script string, chars_per_token double, "
        "byte_share double, entropy_share double, tokens_per_word double, in_band boolean, size long, "
        f"{extra}lang string")), "quality-figures")
    by_figure = list(zip(("chars_per_token", "tokens_per_word", "entropy_share"), *more))
    measured = [c for columns in by_figure for c in columns]
    rough = [c for c in measured if not c.startswith("entropy")]    # hardly depend on the size
    limits = fences(figures, measured, KEYS, "")
    wide = fences(figures, rough, KEYS[:2], "any_")
    outlier = F.lit(False)
    for columns in by_figure:
        beyond = F.lit(True)
        for c in columns:
            low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
            if c in rough:
                low, high = F.coalesce(low, f"any_{c}_low"), F.coalesce(high, f"any_{c}_high")
            beyond &= (F.col(c) < low) | (F.col(c) > high)
        outlier |= F.coalesce(beyond, F.lit(False))
    # a few rows a language: no document travels to find its fences
    return figures.join(F.broadcast(limits), KEYS, "left").join(
        F.broadcast(wide), KEYS[:2], "left").select(
        *[n for n, _ in names[:12]], outlier.alias("outlier"),
        (F.col("in_band") & ~F.col("base_failed") & ~outlier).alias("kept"))
