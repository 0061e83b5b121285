"""Repair of conversations: the cheapest edits that give roles in the order `(s?(ua)+)?`.

A conversation is read as a signature, one letter a row: `X` for a row that must go (blank, or a
duplicate), otherwise the role's class `s`, `u`, `a` or `o`, in upper case where the text is cut
off. What remains to be done behind a row depends on the signature's suffix and the grammar state
alone, so the signatures of all conversations form one automaton, minimised from the end:

* Its nodes are the distinct suffixes; equal suffixes are one node, whichever conversations they end.
  A node holds, for each grammar state, the cost to go and the first edits of the best audit
  suffix with the state they lead to; the rest of that suffix stands at the next node.
* Signatures are made distinct by Spark, dealt by ranges of their reversal and sorted so, which
  brings shared suffixes together: each task builds its part of the automaton.
* Long conversations are cut into blocks of `BLOCK` rows. All a block needs to know of the rest is
  how much dearer each grammar state is than the cheapest: there are few such vectors, and
  a block maps vectors to vectors. These maps run over a conversation's blocks from the end, the
  states from the start, one short row a block.

Rows are put in order by a range sort, which splits a conversation of any length over tasks. The
digest of a conversation's whole text is sequential by nature: one task streams over its blocks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import forget, written

BLOCK, BLOCK_BYTES = 256, 1 << 20     # rows of a block, and bytes of text after which it ends
NODES = 1 << 19                       # of a task's automaton; a full one is started anew
ROLES = ("user", "assistant")
SPACES = "' \\t\\n\\u000b\\f\\r'"
#: Fixed costs and the grammar: states are nothing yet, after s, after u, after a.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = (2, 2, 3, 2)                  # the state after a row whose role may be chosen
SYMBOLS = "XsuaoSUAO"
FINISHED = (0, 4, 2, 0)               # cost to go after the last row: what is open is inserted


def node(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple]:
    """Costs to go before a row, and for each state the first edits, up to those of the row, and
    the state behind it. Ties go to the edit whose initial is least."""
    extra = CUT_OFF if symbol.isupper() else 0
    best = []
    for state in range(4):
        ways = [(DELETE + after[state], "D", state)]
        if symbol != "X":
            target = STEP.get((state, symbol.lower()))
            if target is not None:
                ways.append((extra + after[target], "K", target))
            ways.append((REROLE + extra + after[GIVEN[state]], "R", GIVEN[state]))
        best.append(min(ways))
    for _ in range(3):                 # an insertion leads to another state before the same row
        for state in range(4):
            cost, edits, target = best[GIVEN[state]]
            best[state] = min(best[state], (INSERT + cost, "I" + edits, target))
    return tuple(b[0] for b in best), tuple(b[1:] for b in best)


def level(costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(c - min(costs) for c in costs)


@functools.cache
def vectors() -> tuple[list[tuple[int, ...]], dict[tuple[int, ...], int], dict[str, bytes]]:
    """All levelled cost vectors, their numbers, and where each symbol leads. The first stands for
    the end alone: its like before a row has another number."""
    found, moves = [FINISHED], {s: [] for s in SYMBOLS}
    number: dict[tuple[int, ...], int] = {}
    for v in found:                    # grows while it is read
        for s in SYMBOLS:
            to = level(node(s, v)[0])
            if to not in number:
                number[to] = len(found)
                found.append(to)
            moves[s].append(number[to])
    return found, number, {s: bytes(m) for s, m in moves.items()}


def block_map(signature: str) -> bytes:
    """For each vector behind the block, the number of the vector before it."""
    moves = vectors()[2]
    out = bytes(range(len(vectors()[0])))
    for s in reversed(signature):
        out = out.translate(moves[s].ljust(256, b"\0"))
    return out


class Automaton:
    """Nodes of distinct suffixes, shared by all signatures that were asked for."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        ends = vectors()[0]
        self.child = list(range(len(ends)))            # the first nodes are the ends
        self.costs = list(ends)
        self.edits: list = [(("", 0),) * 4] * len(ends)
        self.known: dict[tuple[str, int], int] = {}

    def node_of(self, signature: str, end: int) -> int:
        if len(self.child) > NODES:
            self.start()
        at = end
        for symbol in reversed(signature):
            key = (symbol, at)
            found = self.known.get(key)
            if found is None:
                costs, edits = node(symbol, self.costs[at])
                found = self.known[key] = len(self.child)
                self.child.append(at)
                self.costs.append(costs)
                self.edits.append(edits)
            at = found
        return at

    def audits(self, signature: str, end: int) -> tuple[list[int], list[str]]:
        """For each state before the signature: the state behind it, and the best edits."""
        first, states, audits = self.node_of(signature, end), [], []
        for state in range(4):
            at, out = first, []
            for _ in signature:
                edits, state = self.edits[at][state]
                out.append(edits)
                at = self.child[at]
            if end == 0:
                out.append("I" * (FINISHED[state] // INSERT))
            states.append(state)
            audits.append("".join(out))
        return states, audits


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies and fault (blank, duplicate, truncated or null): rows that
    agree in the first four are one."""
    known = rows.columns
    copies = F.col("copies") if "copies" in known else F.lit(1)
    kept = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        copies.cast("long").alias("copies")).groupBy("conv_id", "turn", "role", "text").agg(
        F.sum("copies").alias("copies"))
    end = F.expr(f"right(trim(TRAILING {SPACES} FROM text), 1)")
    marked = written(kept.select("*", end.alias("end"), F.unhex(F.sha2("text", 256)).alias("digest")),
                     "dialogue-rows")
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))       # nulls first
    again = marked.filter("end <> '' and copies > 0").groupBy("conv_id", "role", "digest").agg(
        F.count(F.lit(1)).alias("many"), F.min(place).alias("first")).filter("many > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = marked.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                         & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("end") == "", "blank").when(place > F.col("first"), "duplicate").when(
        ~F.col("end").isin(".", "!", "?"), "truncated")
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


class _Block:
    def __init__(self, conv) -> None:
        self.conv, self.signature, self.bytes = conv, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.initials: list[str] = []          # the first and the last row's
        self.low = self.high = None            # turns
        self.roles: list[str] = []
        self.texts: list[str] = []

    def add(self, turn, role: str, text: str, fault: str | None, copies: int) -> int:
        """Takes as many of the copies as fit; those after the first are duplicates."""
        took = min(copies, BLOCK - len(self.signature))
        initial = role[:1]
        if self.initials:
            self.illegal += self.initials[1] + initial not in ("su", "ua", "au")
        self.illegal += took - 1
        self.initials = [self.initials[0] if self.initials else initial, initial]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault in ("blank", "duplicate"):
            letter = "X"
        else:
            letter = initial if initial and initial in "sua" else "o"
            letter = letter.upper() if fault == "truncated" else letter
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
        self.signature += [letter] + ["X"] * (took - 1)
        self.blank += took if fault == "blank" else 0
        self.duplicate += took if fault == "duplicate" else took - 1 if fault != "blank" else 0
        self.truncated += fault == "truncated"
        return took

    def full(self) -> bool:
        return len(self.signature) >= BLOCK or self.bytes >= BLOCK_BYTES


BLOCK_DDL = ("block long, signature string, blank long, duplicate long, truncated long, illegal long, "
             "turns long, initials array<string>, low long, high long, roles array<string>, "
             "texts array<string>")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows in order, in blocks of one conversation; `block` ascends within a conversation."""
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrays = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.string()), pa.int64(),
              pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number, ready, size, now, kind = TaskContext.get().partitionId() << 40, [], 0, None, None

        def out() -> pa.RecordBatch:
            first = number - len(ready)
            columns = [[first + i for i in range(len(ready))],
                       ["".join(b.signature) for b in ready]]
            for name in ("blank", "duplicate", "truncated", "illegal", "turns", "initials", "low",
                         "high", "roles", "texts"):
                columns.append([getattr(b, name) for b in ready])
            return pa.RecordBatch.from_arrays(
                [pa.array([b.conv for b in ready], kind),
                 *(pa.array(c, k) for c, k in zip(columns, arrays))],
                names=["conv_id", *(d.split()[0] for d in BLOCK_DDL.split(", "))])

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, turn, role, text, copies, fault in zip(*(
                    batch.column(c).to_pylist()
                    for c in ("conv_id", "turn", "role", "text", "copies", "fault"))):
                while True:
                    if now is None or now.conv != conv or now.full():
                        if now is not None:
                            ready.append(now)
                            number += 1
                            size += now.bytes
                        now = _Block(conv)
                        if len(ready) >= 4096 or size >= 8 * BLOCK_BYTES:
                            yield out()
                            ready, size = [], 0
                    if copies <= 0:        # a conversation may have lost all of its rows
                        break
                    copies -= now.add(turn, role, text, fault, copies)
                    fault = fault if fault == "blank" else "duplicate"
                    if copies <= 0:
                        break
        if now is not None:
            ready.append(now)
            number += 1
            yield out()

    return written(ordered.mapInArrow(build, f"conv_id {kind}, {BLOCK_DDL}"), "dialogue-blocks")


def _mapped(df: DataFrame, make: Callable[..., tuple], ddl: str, kinds: list, inputs: list[str],
            keep: list[str]) -> DataFrame:
    """df's columns `keep`, with those that make(inputs) gives for a row."""
    names = [d.split()[0] for d in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in inputs]
            out = list(zip(*map(make, *columns))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(out, kinds)],
                names=[*keep, *names])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{fields}, {ddl}")


def _scan(df: DataFrame, start: int, follow: Callable[[int, object], int], by: str, name: str,
          down: bool) -> DataFrame:
    """block and `name`: what runs over the blocks of each conversation, before each of them."""
    order = F.col("block").desc() if down else F.col("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value = object(), start
        for batch in batches:
            out = []
            for conv, with_ in zip(batch.column("conv_id").to_pylist(), batch.column(by).to_pylist()):
                if conv != last:
                    last, value = conv, start
                out.append(value)
                value = follow(value, with_)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.int32())],
                                             names=["block", name])

    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).select(
        "conv_id", "block", by).mapInArrow(run, f"block long, {name} int")


def audited(cut: DataFrame) -> DataFrame:
    """block and audit of every block."""
    short = cut.select("conv_id", "block", "signature")
    several = short.groupBy("conv_id").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select(
        F.col("conv_id").alias("c"))
    several = short.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    maps = _mapped(several.select("signature").distinct(), lambda s: (block_map(s),), "map binary",
                   [pa.binary()], ["signature"], ["signature"])
    ends = written(_scan(several.join(maps, "signature"), 0, lambda value, map_: map_[value], "map",
                         "end", True), "dialogue-ends")
    known = written(short.join(ends, "block", "left").select(
        "conv_id", "block", "signature", F.col("end").isNotNull().alias("long"),
        F.coalesce("end", F.lit(0)).alias("end")), "dialogue-signatures")
    automaton: list[Automaton] = []        # one a task

    def audits(signature: str, end: int) -> tuple:
        if not automaton:
            automaton.append(Automaton())
        return automaton[0].audits(signature, end)

    distinct = known.select("signature", "end").distinct().repartitionByRange(
        F.reverse("signature")).sortWithinPartitions(F.reverse("signature"))
    best = written(_mapped(distinct, audits, "states array<int>, audits array<string>",
                           [pa.list_(pa.int32()), pa.list_(pa.string())], ["signature", "end"],
                           ["signature", "end"]), "dialogue-audits")
    with_best = known.join(best, ["signature", "end"])
    entered = _scan(with_best.filter("long"), 0, lambda state, states: states[state], "states",
                    "state", False)
    state = F.coalesce("state", F.lit(0)) + 1
    return with_best.join(entered, "block", "left").select(
        "block", F.element_at("audits", state.cast("int")).alias("audit"), F.coalesce(
            "state", F.lit(0)).alias("state"))


def applied(signature: str, roles: list[str], texts: list[str], audit: str,
            state: int) -> tuple[int, list[str], list[str]]:
    """Cost of the edits, and role and text of each row that is left."""
    cost, out_roles, out_texts = 0, [], []
    row = 0
    left = iter(zip(roles, texts))
    for edit in audit:
        if edit == "I":
            role, text = ROLES[state == 2], ""
            cost += INSERT
            state = GIVEN[state]
        else:
            symbol = signature[row]
            row += 1
            role, text = next(left) if symbol != "X" else ("", "")
            if edit == "D":
                cost += DELETE
                continue
            cost += CUT_OFF if symbol.isupper() else 0
            if edit == "K":
                state = STEP[state, symbol.lower()]
            else:
                role = ROLES[state == 2]
                cost += REROLE
                state = GIVEN[state]
        out_roles.append(role)
        out_texts.append(text)
    return cost, out_roles, out_texts


def repaired_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of all conversations with cost, audit, and the repaired roles and texts."""
    cut = blocks(faulted(rows))
    joined = cut.join(audited(cut), "block")
    keep = ["conv_id", "block", "blank", "duplicate", "truncated", "illegal", "turns", "initials",
            "low", "high", "audit"]
    texts = pa.list_(pa.string())
    return _mapped(joined, applied, "cost long, new_roles array<string>, new_texts array<string>",
                   [pa.int64(), texts, texts], ["signature", "roles", "texts", "audit", "state"], keep)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (ascending within a conversation), role and text after the repair."""
    found = repaired_blocks(rows).select("conv_id", "block", F.posexplode(
        F.arrays_zip("new_roles", "new_texts")).alias("at", "row"))
    return found.select("conv_id", F.struct("block", "at").alias("place"),
                        F.col("row.new_roles").alias("role"), F.col("row.new_texts").alias("text"))


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.

    rows: conv_id, turn, role and text; a column copies, if there is one, says how often a row stands
    in its place (0: not at all, but its conversation is returned). A conversation's rows go by turn
    (nulls first), then role, then text. A row's first fault counts: blank (no word), duplicate (role
    and text seen earlier), truncated (the last character that is no white space is not `.!?`).
    Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (for blank and duplicate rows the only
    one), Insert 2; truncated rows that stay cost 1. Audits of equal cost: the least in ASCII.

    Null role or text: one space. A null conv_id is a conversation; a null turn counts in no gap.
    Very long conversations are cut into blocks. No rows left: zeros, an empty audit, the digest of
    an empty text. An empty table stays empty. Other columns are not read.
    """
    done = repaired_blocks(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *fields, "audit", "repaired_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, object()
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != last:
                    if now is not None:
                        ready.append(ended(last, now))
                    last = row["conv_id"]
                    now = dict.fromkeys([*fields, "turns"], 0) | {
                        "audit": [], "sha": hashlib.sha256(), "empty": True, "low": None,
                        "high": None, "initial": None}
                for name in fields[1:]:
                    now[name] += row[name]
                if row["initials"]:
                    if now["initial"] is not None:
                        now["illegal"] += (now["initial"] + row["initials"][0]
                                           not in ("su", "ua", "au"))
                    now["initial"] = row["initials"][1]
                if row["low"] is not None:
                    now["turns"] += row["turns"] - (row["low"] == now["high"])
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"]
                now["audit"].append(row["audit"])
                lines = "\n".join(map(":".join, zip(row["new_roles"], row["new_texts"])))
                if row["new_roles"]:
                    now["sha"].update((lines if now["empty"] else "\n" + lines).encode())
                    now["empty"] = False
            yield rows_of(ready, batch)
        if now is not None:
            yield rows_of([ended(last, now)], batch)

    def ended(conv, now: dict) -> tuple:
        if now["low"] is not None:
            now["gaps"] = now["high"] - now["low"] + 1 - now["turns"]
        return (conv, *(now[f] for f in fields), "".join(now["audit"]), now["sha"].hexdigest())

    def rows_of(ready: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*ready)) or [()] * len(names)
        kinds = [batch.column("conv_id").type, *[pa.int64()] * len(fields), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=names)

    ddl = ", ".join([f"conv_id {kind}", *(f"{f} long" for f in fields), "audit string",
                     "repaired_sha256 string"])
    return done.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(digest, ddl)
