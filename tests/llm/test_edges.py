"""Whole results against brute force, columns with clashing names, empty tables, long texts."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from tickloom.llm import dac, fertility, mixing, piece_codec, queries, repeats, simhash, topk

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BPE, PIECE = (public_tokenizers.path(n) for n in (queries.BYTE_BPE, queries.PIECE_BPE))


def prose(rng, n, lang=""):
    return " ".join(rng.choice(["the", "cat", "über", "été", "x1", "mat.", "Dog"])
                    + rng.choice(["", "a", "b", "cd", "ing"]) + lang for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(12)
    shared = prose(rng, 60)
    texts = [None, "", "123 456", prose(rng, 200), prose(rng, 900)]
    texts += [prose(rng, 40) + " " + shared + " " + prose(rng, 30) for _ in range(8)]
    texts += [texts[4], texts[4].replace("cat", "cat", 1), texts[5], shared, "é" * 300]
    return [(i, t, ["en", "de", "fr"][i % 3], [None, "b", "a"][i % 3], len(t or ""))
            for i, t in enumerate(texts)]


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long"
                          ).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in corpus() if r[1] and any(map(str.isalpha, r[1]))]
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    kept, linked = [], {}
    for r in rows:                                    # ids ascend: the first of a group stays
        near = {linked[o] for o in linked if (prints[o] ^ prints[r[0]]).bit_count() <= 3}
        root = min(near, default=r[0])
        for o in linked:
            linked[o] = root if linked[o] in near else linked[o]
        linked[r[0]] = root
    kept = [r for r in rows if linked[r[0]] == r[0]]
    seen, cut = set(), []
    for r in kept:
        data = r[1].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(data[p:p + 100])
        text = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        cut.append((r[0], text, *r[2:4], len(text)))
    assert len(kept) < len(rows) and any(a[1] != b[1] for a, b in zip(cut, kept))
    frame = spark.createDataFrame(cut, "doc_id long, text string, lang string, source string, n_chars long")
    sized = mixing.measured(frame)
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mixed(sized, mixing.balance(sized)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = collections.Counter()
    for doc, text, *_ in cut:
        want[doc, tuple(library.encode(text))] += copies[doc]
    got = collections.Counter((r["doc_id"], tuple(r["ids"]))
                              for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tilts_equal_an_independent_solver(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 60), "s%d" % (i % 4)) for i in range(500)]
    sized = mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plans = [{r["source"]: r for r in mixing.balance(sized.repartition(n)).collect()} for n in (2, 7)]
    assert all(plans[0][s]["tilt"] == plans[1][s]["tilt"] for s in plans[0])     # whatever the order
    for source, plan in plans[0].items():
        sizes = np.array([len(words(r[1])) for r in rows if r[2] == source], float)
        assert plan["source_size"] == sizes.sum()
        if plan["target"] >= 2 * sizes.sum() * (1 - 1e-9):
            continue
        low, high = -1.0, 1.0
        for _ in range(200):                          # plain bisection on the dual's slope
            mid = (low + high) / 2
            taken = (sizes * np.minimum(2, np.exp(np.minimum(mid * sizes, 700)))).sum()
            low, high = (mid, high) if taken < plan["target"] else (low, mid)
        assert plan["tilt"] == pytest.approx(low, abs=1e-7)


def test_fences_equal_numpy(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(20, 200)), "en") for i in range(140)]
    rows += [(900 + i, " ".join("".join(rng.choice("qxzjk") for _ in range(9)) for _ in range(60)), "en")
             for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.judge(frame, [PIECE, BPE]).collect()}
    codec, other = piece_codec.PieceCodec(PIECE, verify=False), fertility.encoder(BPE)
    byte = np.array([k == piece_codec.BYTE for *_, k in codec.model.pieces])
    figures = {}
    for doc, text, _ in rows:
        n = len(words(text))
        mine = []
        for encode, table in ((codec.encode, byte), (other, None)):
            ids = encode([text])[0]
            chars, _, entropy = fertility.fertility(ids, text, table)
            mine.append((chars, len(ids) / n, entropy))
        figures[doc] = (n.bit_length(), mine)
    base = {d for d in figures if not got[d]["base_failed"]}

    def fence(docs, vocabulary, figure):
        values = [round(figures[d][1][vocabulary][figure], 3) for d in docs]
        if len(values) < fertility.GROUP:
            return None
        q = np.percentile(values, [25, 50, 75])
        far = fertility.FENCE * max(q[2] - q[0], fertility.NARROWEST * q[1])
        return q[0] - far, q[2] + far

    for d in base:
        same = [o for o in base if figures[o][0] == figures[d][0]]
        outlier = False
        for figure in range(3):
            beyond = []
            for v in (0, 1):
                limits = fence(same, v, figure) or (None if figure == 2 else fence(base, v, figure))
                value = figures[d][1][v][figure]
                beyond.append(limits is not None and not limits[0] <= value <= limits[1])
            outlier |= all(beyond)
        assert got[d]["outlier"] == outlier, d
        band = fertility.BANDS[got[d]["script"]]
        chars, share, entropy = (got[d][c] for c in ("chars_per_token", "byte_share", "entropy_share"))
        good = (band.least_chars <= chars <= band.most_chars and share <= band.most_bytes
                and entropy >= band.least_entropy)
        assert got[d]["kept"] == (good and not outlier), d
    assert any(got[900 + i]["outlier"] for i in range(5))


def test_repeats_tell_texts_of_one_id_apart(spark):
    seen, pair, n = {}, None, 0
    while pair is None:                # two texts whose hashes agree in the lowest 24 bits
        text = f"{n} " + prose(random.Random(n), 40)
        low = xxhash.xxh64_intdigest(text.encode(), 42) % (1 << 24)
        pair = (seen[low], text) if low in seen else None
        seen[low], n = text, n + 1
    passage = prose(random.Random(-1), 60)
    rows = [(1, passage), (5, pair[0] + " " + passage), (5, pair[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["n_bytes"]: r["n_removed"] for r in repeats.remove_repeats(frame).collect()}
    assert got[len(pair[1].encode())] == 0
    assert got[len(rows[1][1].encode())] >= len(passage.encode())


def test_clashing_names_and_empty_tables(spark, tmp_path):
    rng = random.Random(1)
    extra = "ids string, n int, key string, size string, start int, part int, of string, at string"
    row = ("i", 1, "k", "s", 2, 3, "o", "a")
    frame = spark.createDataFrame([(i, prose(rng, 30), "en", "s", *row) for i in range(6)] +
                                  [(None, None, None, None, *row)],
                                  f"doc_id long, text string, lang string, source string, {extra}")
    judged = fertility.judge(frame, [PIECE, BPE])
    assert judged.count() == 7 and judged.limit(0).columns == judged.columns
    assert piece_codec.encode_documents(frame, PIECE).filter("round_trip").count() == 7
    for df, n in ((frame, 7), (frame.limit(0), 0)):
        path = str(tmp_path / f"tokens{n}")
        dac.write_tokens(df, path, BPE)
        assert dac.document_tokens(dac.read_tokens(spark, path), digests_only=True).count() == n
    vectors = spark.createDataFrame(
        [(i, [float(i), 1.0], "x", 1, "y", 2, "z") for i in range(25)],
        "vec_id long, embedding array<float>, id string, dim int, v string, sq int, at string")
    from pyspark.sql import functions as F
    assert topk.top_k(vectors, F.col("id") % 20 == 0, 3).count() == 6
    assert topk.top_k(vectors.limit(0), F.col("id") % 20 == 0, 3).count() == 0


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(4)
    text = prose(rng, 70_000)                                    # over 65,536 shingles
    frame = spark.createDataFrame([(1, text, "en"), (2, "short one", "en")],
                                  "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame).collect()}
    assert got[1]["fp"] % (1 << 64) == fingerprint(text)
    path = str(tmp_path / "tokens")
    dac.write_tokens(frame, path, BPE)
    tokens = {r["doc_id"]: r for r in
              dac.document_tokens(dac.read_tokens(spark, path), digests_only=True).collect()}
    from tokenizers import Tokenizer
    ids = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids + [2]
    assert tokens[1]["n_tokens"] == len(ids)
    assert tokens[1]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    judged = {r["doc_id"]: r for r in fertility.judge(frame, [PIECE, BPE]).collect()}
    assert judged[1]["n_words"] == 70_000
    pieces = {r["doc_id"]: r for r in piece_codec.encode_documents(frame, PIECE).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert list(pieces[1]["ids"]) == library.encode(text) and pieces[1]["round_trip"]
