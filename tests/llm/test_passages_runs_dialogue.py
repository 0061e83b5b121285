"""Passages, periodic runs and conversation repair against brute force."""

import functools
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import debruijn, dialogue, periodic, queries, word_scan

DOCS = "doc_id long, text string, part int, key string, n_words string, start double"
TURNS = "conv_id long, turn long, role string, text string, c string, block int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_words_of_joined_texts():
    texts = ["", "a", " b\tc ", "d", "é\x0b\x1c \xa0", "  "]
    data = "".join(texts).encode()
    ends = np.cumsum([0] + [len(t.encode()) for t in texts])
    start, end, row = word_scan.words_of(np.frombuffer(data, np.uint8), ends)
    got = [(int(r), data[s:e].decode()) for s, e, r in zip(start, end, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]


def test_parts_of_a_long_text_overlap():
    text = (" ".join("w%d" % (i * 7919) for i in range(400)) + " " + "long" * 300 + " end").encode()
    whole = text.split()
    seen = {}
    for part, start, end, number in word_scan.long_text(np.frombuffer(text, np.uint8), 100, 4):
        found = [bytes(part[s:e]) for s, e in zip(start, end)]
        assert whole[number:number + len(found)] == found
        for k in range(len(found) - 4):
            assert seen.setdefault(number + k, part is not None)
    assert sorted(seen) == list(range(len(whole) - 4))


# passages

def expected_passages(rows, window):
    seen, out = {}, []
    tokens = [(-(1 << 63) if r[0] is None else r[0], words(r[1])) for r in rows]
    for doc, ws in tokens:
        for p in range(len(ws) - window + 1):
            w = tuple(ws[p:p + window])
            seen[w] = min(seen.get(w, doc), doc)
    for doc, ws in tokens:
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if seen[tuple(ws[p:p + window])] < doc:
                gone[p:p + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((len(ws), sum(gone), sha(kept)))
    return out


def passage_texts():
    rng = random.Random(5)
    prose = lambda n, k=900: " ".join("w%d" % rng.randrange(k) for _ in range(n))
    shared, common = prose(90), prose(30)
    texts = [None, "", " \n\t", "one two", prose(12), shared, prose(700, 3), "x " * 400, "x " * 80]
    for _ in range(12):
        cut = rng.randrange(40)
        inner = shared.split()[cut:cut + rng.randrange(20, 50)]
        texts.append(f"{prose(20)}\n{common} {prose(9)}\t{' '.join(inner)} {prose(3)} {common}")
    near = texts[-1].split()
    near[25] = "CHANGED"
    return texts + [texts[10], texts[10], " ".join(near), "y " + shared + " " + shared, "x " * 13]


@pytest.mark.parametrize("held,piece,waiting", [(1 << 20, 1 << 20, 1 << 16), (40, 300, 1)])
def test_passages_equal_brute_force(spark, monkeypatch, held, piece, waiting):
    monkeypatch.setattr(debruijn, "HELD", held)
    monkeypatch.setattr(debruijn, "PIECE", piece)
    monkeypatch.setattr(debruijn, "WAITING", waiting)
    texts = passage_texts()
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (rows[11][0], texts[14]), (None, texts[9]), (None, texts[12])]
    frame = spark.createDataFrame([(*r, 1, "k", "n", 0.5) for r in rows], DOCS).repartition(3)
    out = debruijn.remove_passages(frame, with_text=True)
    assert out.columns == ["doc_id", "part", "key", "start", "n_words", "n_removed", "kept_sha256",
                           "text"]
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_removed"],
                  r["kept_sha256"]) for r in out.collect())
    expected = sorted((r[0] is not None, r[0], *e)
                      for r, e in zip(rows, expected_passages(rows, 13)))
    assert got == expected and any(e[2] for e in got)
    assert all(sha(r["text"]) == r["kept_sha256"] for r in out.collect())


def test_passages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert debruijn.remove_passages(empty).count() == 0


def test_spans_name_their_sources(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    frame = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} y {b}")], "doc_id long, text string")
    spans = sorted((r["at"], r["n"], r["src_doc"], r["src_at"], r["doc"])
                   for r in debruijn.repeated_spans(frame).collect())
    assert spans == [(1, 28, 1, 0, 3), (42, 28, 2, 0, 3)]       # maximal paths, not single edges


# periodic runs

def expected_runs(ws):
    found = {}
    for q in range(1, len(ws) // 3 + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected_row(ws):
    runs = expected_runs(ws)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in sorted(runs, key=lambda r: (r[0], r[2])))),
            sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def periodic_text(rng):
    out = []
    while rng.random() < 0.85:
        k = rng.choice([1, 2, 3, 5, 30])
        out += ["é%d" % rng.randint(0, k) for _ in range(rng.randint(1, 40))] * rng.choice([1, 3, 4, 9])
    return " ".join(out)


def test_runs_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "a " * 23, "a " * 24, "a b " * 12, "ab c " * 5000]
    texts += [periodic_text(rng) for _ in range(150)]
    frame = spark.createDataFrame([(i, t, 1, "k", "n", 0.5) for i, t in enumerate(texts)], DOCS)
    out = periodic.periodic_runs(frame)
    assert out.columns[:4] == ["doc_id", "part", "key", "n_words"]
    for r in out.collect():
        got = tuple(r[c] for c, _ in periodic.ADDED)
        assert got == expected_row(words(texts[r["doc_id"]])), r["doc_id"]
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(2)
    array = np.concatenate([np.tile(rng.integers(0, 2, 17), 9), rng.integers(0, 2, 200), [7]])
    lce = periodic.Extensions(array)
    left, right = rng.integers(0, len(array), (2, 4000))
    left, right = left[left != right], right[left != right]
    for a, b, got in zip(left, right, lce(left, right)):
        n = 0
        while max(a, b) + n < len(array) and array[a + n] == array[b + n]:
            n += 1
        assert got == n


def test_very_long_periodic_text_is_quick():
    import time
    begin = time.time()
    assert periodic.answers([[b"a", b"b", b"c"] * 100_000])[0][:4] == (1, 0, 300_000, 3)
    assert time.time() - begin < 60


def test_repeated_tail():
    changed = 0
    for doc in range(60):
        ws = [b"%d" % i for i in range(50)]
        got = queries.repeated_tail(doc, ws)
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a, changed = g % 50, changed + 1
            p = 1 + (50 - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(50)]
        assert got == ws
    assert changed and queries.repeated_tail(None, [b"a"]) == [b"a"]


# conversations

def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        draw = zlib.crc32(key.encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def expected_repair(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        ink = "".join(words(text))
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen
                      else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(rows, rows[1:])]
    turns = [r[1] for r in rows if r[1] is not None]

    @functools.cache
    def best(i, state, inserts=3):
        """The least (cost, audit, lines) of all ways to go on."""
        ways = [(1 << 30, "", ())]
        if i == len(rows) and state in "0a":
            ways.append((0, "", ()))
        if inserts:
            ways += [go(i, new[0], inserts - 1, 2, "I", f"{new}:") for new in allowed(state)]
        if i < len(rows):
            role, text = rows[i][2:]
            cost, audit, lines = best(i + 1, state)
            ways.append((cost + 3, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                if role and role[0] in following[state]:
                    ways.append(go(i + 1, role[0], 3, extra, "K", f"{role}:{text}"))
                ways += [go(i + 1, new[0], 3, 2 + extra, "R", f"{new}:{text}")
                         for new in allowed(state)]
        return min(ways)

    def go(i, state, inserts, price, edit, line):
        cost, audit, lines = best(i, state, inserts)
        return cost + price, edit + audit, (line, *lines)

    def allowed(state):
        return [r for r in ("user", "assistant") if r[0] in following[state]]

    following = {"0": "su", "s": "u", "u": "a", "a": "u"}
    cost, audit, lines = best(0, "0")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))


def conversations():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(120)]:
        n = rng.choice([1, 2, 3, 5, 8, 12]) if conv != 7 else 60
        for turn in range(n):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "usher"])
            text = rng.choice(["Yes.", "No!", "cut", "Eh? \n", "a. ", " ", None,
                               f"text {rng.randrange(9)}."])
            rows.append((conv, rng.choice([turn] * 9 + [turn + 3, None]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("block,size,nodes", [(256, 1 << 20, 1 << 19), (2, 1 << 20, 40), (9, 12, 1)])
def test_repair_equals_brute_force(spark, monkeypatch, block, size, nodes):
    for name, value in (("BLOCK", block), ("BLOCK_BYTES", size), ("NODES", nodes)):
        monkeypatch.setattr(dialogue, name, value)
    rows = conversations()
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS).repartition(3)
    out = dialogue.repair(queries.damaged(frame))
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    assert set(got) == set(by_conv) and out.count() == len(by_conv)
    for conv, some in by_conv.items():
        assert got[conv] == expected_repair(damage(some)), conv


def test_repair_of_hot_and_empty_conversations(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(2000)]
    rows += [(2, 0, "user", "same.")] * 700
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in dialogue.repair(frame).collect()}
    assert got[1]["audit"] == "K" * 2000 and got[1]["cost"] == 0
    assert got[2]["audit"] == "D" * 700 or got[2]["cost"] == 699 * 3 + 2
    assert (got[2]["duplicate"], got[2]["illegal"], got[2]["gaps"]) == (699, 699, 0)
    lines = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:2000])
    assert got[1]["repaired_sha256"] == sha(lines)
    assert dialogue.repair(frame.limit(0)).count() == 0
    gone = dialogue.repair(frame.withColumn("copies", frame["turn"] * 0)).collect()
    assert [tuple(r)[1:] for r in gone] == [(0, 0, 0, 0, 0, 0, "", sha(""))] * 2


def test_repaired_rows(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "assistant", "B.")],
                                  "conv_id long, turn long, role string, text string")
    rows = dialogue.repaired_rows(frame).orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "A."), ("assistant", "B.")]


def test_few_vectors_stand_for_all_suffixes():
    found, number, moves = dialogue.vectors()
    assert len(found) < 100 and all(len(m) == len(found) for m in moves.values())
