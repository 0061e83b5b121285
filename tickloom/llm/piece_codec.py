"""SentencePiece models encoded and decoded by the tokenizers library.

The model file (a protobuf) is parsed here; its normaliser, white-space marker, scores and byte
fallback are rebuilt as a tokenizers pipeline. Unigram models keep their scores; for BPE models
the order of merges follows from the scores. Every distinct chunk that is encoded is held against
the sentencepiece library, so parity is verified for all that the corpus contains; for models with
a normaliser of their own or other rules for spaces, whole texts are.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import kept, pieces, text_or_empty
from tickloom.llm.encoding import MARKS, ChunkedEncoder, Cut

MARK = "▁"
#: Pieces across a place where texts are cut: a letter before a mark, a line feed beside anything.
CROSSING = re.compile(rf"[A-Za-zÀ-ÖØ-öø-ȿ][{re.escape(MARKS)}]|\n.|.\n", re.DOTALL)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS, JOINED = 2, 64        # of the library in a task; chunks that it gets as one text


@dataclass
class Model:
    """The fields of a model file that encoding needs, with the format's defaults."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield key >> 3, data[at:at + size]
        at += size


def parse(data: bytes) -> Model:
    """Field numbers are those of the published model format."""
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            normaliser = dict(fields(value))
            model.charsmap = normaliser.get(2, b"")
            model.dummy_prefix = bool(normaliser.get(3, 1))
            model.strip_spaces = bool(normaliser.get(4, 1))
            model.escape_spaces = bool(normaliser.get(5, 1))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models")
    if any(kind == USER for *_, kind in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    return model


class PieceCodec:
    """encode() and decode() of whole texts; `unequal` holds chunks that the other library encodes
    differently (none is expected; such chunks keep this library's ids)."""

    def __init__(self, path: str, verify: bool = True) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import Tokenizer, models, normalizers

        with open(path, "rb") as file:
            data = file.read()
        self.model = model = parse(data)
        ids = {piece: i for i, (piece, *_) in enumerate(model.pieces)}
        unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
        if model.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown,
                                  model.byte_fallback)
        else:
            core = models.BPE(vocab=ids, merges=self._merges(ids), byte_fallback=model.byte_fallback,
                              unk_token=model.pieces[unknown][0] if unknown is not None else None,
                              fuse_unk=True)
        tokenizer = Tokenizer(core)
        self.normaliser = normalizers.Precompiled(model.charsmap) if model.charsmap else None
        # chunks can be cut at a marker only if no piece has one after another character
        whole = any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL)
        other, self.unequal = None, set()
        self.whole_texts = None        # the other library, where chunks can't be held against it
        if verify:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_file=path)
            if model.charsmap or not model.dummy_prefix or not model.escape_spaces:
                other, self.whole_texts = None, other

        starts = np.array([p.startswith(MARK) for p, *_ in model.pieces])

        def batch(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, "<u4")      # the fast one spares the offsets, not needed here
                    for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(chunks: list[str]) -> list[bytes]:
            """Chunks with one marker, at their start, go to the library joined: the pieces that
            begin with the marker tell them apart again."""
            found: list = [None] * len(chunks)
            simple = [] if whole else [i for i, c in enumerate(chunks) if c.rfind(MARK) == 0]
            groups = [simple[i:i + JOINED] for i in range(0, len(simple), JOINED)]
            for group, ids in zip(groups, batch(["".join([chunks[i] for i in g]) for g in groups])):
                cuts = np.flatnonzero(starts[ids])
                if len(cuts) == len(group):
                    data, cuts = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                    for i, low, high in zip(group, cuts, cuts[1:]):
                        found[i] = data[low:high]
            rest = [i for i, own in enumerate(found) if own is None]
            for i, own in zip(rest, batch([chunks[i] for i in rest])):
                found[i] = own.tobytes()
            if other is not None:
                plain = [c.removeprefix(MARK).replace(MARK, " ") for c in chunks]
                theirs = other.encode(plain, num_threads=1)
                self.unequal.update(c for c, p, a, b in zip(chunks, plain, found, theirs)
                                    if p and a != array("I", b).tobytes())
            return found

        self.chunks = ChunkedEncoder(encode, MARK, whole)
        # texts with the marker are not for Cut; none are, if a piece may lie across its cuts or
        # more than spaces becomes markers
        plain = (model.kind == BPE and model.dummy_prefix and model.escape_spaces and not model.charsmap
                 and sum(kind == BYTE for *_, kind in model.pieces) == 256 and model.byte_fallback
                 and not whole and not any(CROSSING.search(p) for p, _, k in model.pieces if k == NORMAL))
        self.uncut = MARK if plain else None
        self.parts = ChunkedEncoder(encode, MARK)       # remembers parts, the other chunks
        self.bytes = [self._bytes(p, kind) for p, _, kind in model.pieces]

    def _merges(self, ids: dict[str, int]) -> list[tuple[str, str]]:
        """Pairs whose union is a piece, the best-scored union first."""
        found = []
        for piece, score, kind in self.model.pieces:
            if kind != NORMAL:
                continue
            pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
            pairs = [p for p in pairs if p[0] in ids and p[1] in ids]
            found += [(-score, ids[a], ids[b], a, b) for a, b in pairs]
        return [(a, b) for *_, a, b in sorted(found)]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else piece.encode()

    def normalise(self, text: str) -> str:
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        if self.model.strip_spaces:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        text = (" " if self.model.dummy_prefix else "") + text
        return text.replace(" ", MARK) if self.model.escape_spaces else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.chunks([self.normalise(t) for t in texts])

    __call__ = encode

    def of_cut(self, cut: Cut, rows: list[int]) -> dict[int, np.ndarray]:
        """By row, the ids of those of the rows that are cut."""
        return cut.ids(rows, self.parts.of_parts, spaced=True)

    def parity(self, text: str, ids: np.ndarray) -> bool:
        """Whether both libraries agree on a text that has been encoded: on all its chunks or, for
        models that normalise texts or treat spaces otherwise, on the ids of the whole text."""
        if self.whole_texts is not None:
            return self.whole_texts.encode(text) == ids.tolist()
        if not self.unequal:
            return True
        normal = self.normalise(text)
        return not any(c in normal for c in self.unequal)

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), n_bytes_fallback, round_trip (decoding gives the text back), parity (both libraries
    agree on every chunk, or on the whole text) and, with_ids, ids.

    Null or empty text: no ids, and the round trip holds. Null and repeated ids pass through; an
    empty table gives no rows; other columns are not read. A text with the marker character itself
    comes back with a space for it, and round_trip says so.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = ("doc_id long, n_tokens long, ids_crc32 long, n_bytes_fallback long, "
              "round_trip boolean, parity boolean" + (", ids array<int>" if with_ids else ""))
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
             ("n_bytes_fallback", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())]
    kinds = pa.schema(kinds + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(f"pieces:{model_path}", lambda: PieceCodec(model_path))
        byte = np.array([kind == BYTE for *_, kind in codec.model.pieces])
        for batch in batches:
            for low, high in pieces(batch, "text", 1 << 22):
                some = batch.slice(low, high - low)
                texts = some.column("text").to_pylist()
                ids = codec.encode(texts)
                out = [some.column("doc_id"), [len(i) for i in ids],
                       [zlib.crc32(i.tobytes()) for i in ids],
                       [int(byte[i].sum()) for i in ids],
                       [codec.decode(i) == t for i, t in zip(ids, texts)],
                       [codec.parity(t, i) for t, i in zip(texts, ids)]]
                if with_ids:
                    out.append([i.astype(np.int32) for i in ids])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) if isinstance(v, list) else v for v, f in zip(out, kinds)],
                    schema=kinds)

    return rows.mapInArrow(run, schema)
