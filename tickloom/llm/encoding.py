"""Token ids of whole texts from a tokenizer library that is asked once a distinct chunk.

A text is cut where the tokenizer can never join tokens: at a lone joint (the space or its marker)
between two characters that are no white space. Equal chunks have equal ids, so a bounded memory
of chunks saves most calls of the library; the ids are those of the whole text.

Texts of a batch can also be cut together and finer (Cut): each distinct part of the batch is then
looked up once, by as many encoders as need it.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Callable, Sequence
from operator import attrgetter, not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY, LARGE = 64 << 20, 200 << 20     # bytes of chunks remembered; where each costs a call, more
ENTRY, LONGEST = 200, 48                # bytes that one takes, roughly; characters of the longest
ENDS = frozenset(".,;:!?)")    # marks that are no word's part and end most chunks that are not words
FAR_LETTER = "\u0250"      # letters before it are letters to every version of Unicode
#: White space that is rare in texts; where one occurs, cuts are looked for with care.
RARE_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f"
                        r"\u205f\u3000]")
#: Texts that need care at their cuts, in the syntax of Arrow's expressions.
CARE = "^$|^ | $|  | \n|\n |[" + "".join(c for c in map(chr, range(0x3001)) if RARE_SPACE.match(c)) + "]"
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\\"    # the ASCII ones that never begin a word's part
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
MARK[list(MARKS.encode())] = True


class Cut:
    """Texts cut before each space, between a letter and a mark and around lone line feeds: `parts`
    holds each distinct part once, a space before it included, `rows` the numbers of a text's parts,
    in order. Texts that need care, or in which an expression of `also` (in the syntax of Arrow's)
    is found, are not cut: their row is None."""

    def __init__(self, texts: pa.Array, also: Sequence[str] = ()) -> None:
        care = pc.match_substring_regex(texts, "|".join([CARE, *also]))
        plain = texts.filter(pc.invert(care)).cast(pa.large_string())
        ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset:plain.offset + len(plain) + 1]
        if not len(plain):
            self.parts, self.rows = [], [None] * len(texts)
            return
        data = np.frombuffer(plain.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        begins = self.begins(data)
        begins[ends[:-1]] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        coded = pa.LargeStringArray.from_buffers(
            len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        self.parts: list[str] = coded.dictionary.to_pylist()
        numbers = coded.indices.to_numpy()
        cuts = np.searchsorted(starts, ends)
        found = map(numbers.__getitem__, map(slice, cuts[:-1].tolist(), cuts[1:].tolist()))
        self.rows = [None if careful else next(found) for careful in care.to_pylist()]

    @staticmethod
    def begins(data: np.ndarray) -> np.ndarray:
        """Where a part begins. Letters are those of ASCII and of U+00C0 to U+023F."""
        feed, after = data == 10, LETTER[data]
        wide = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC8)        # leads of two bytes
        wide &= (data[:-1] != 0xC3) | ((data[1:] != 0x97) & (data[1:] != 0xB7))
        after[1:] |= wide
        found = data == 32
        found[1:] |= after[:-1] & MARK[data[1:]]
        found[1:] |= feed[1:] & ~feed[:-1]
        lone = feed.copy()
        lone[1:] &= ~feed[:-1]
        found[1:] |= lone[:-1] & ~feed[1:]
        return found

    def ids(self, rows: list[int], encode: Callable[[list[str]], list[bytes]],
            spaced: bool = False) -> dict[int, np.ndarray]:
        """By row, the ids of those of the rows that are cut. encode has the ids of distinct parts;
        spaced: a text's first part is encoded as if a space stood before it."""
        rows = [i for i in rows if self.rows[i] is not None]
        needed = np.zeros(len(self.parts), bool)
        for i in rows:
            needed[self.rows[i][1:] if spaced else self.rows[i]] = True
        numbers = np.flatnonzero(needed)
        heads = {i: " " + self.parts[self.rows[i][0]] for i in rows} if spaced else {}
        more = list(set(heads.values()))
        found = encode([self.parts[i] for i in numbers.tolist()] + more)
        head = dict(zip(more, found[len(numbers):]))
        del found[len(numbers):]
        sizes, starts = np.zeros((2, len(self.parts)), np.int64)
        sizes[numbers] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts[numbers] = np.cumsum(sizes[numbers]) - sizes[numbers]
        flat = np.frombuffer(b"".join(found), "<u4")
        out = {}
        for i in rows:
            row = self.rows[i][1:] if spaced else self.rows[i]
            size = sizes[row]
            last = np.cumsum(size)
            at = np.arange(last[-1] if len(row) else 0) + np.repeat(starts[row] - last + size, size)
            own = flat[at]
            out[i] = np.concatenate([np.frombuffer(head[heads[i]], "<u4"), own]) if spaced else own
        return out


class ChunkedEncoder:
    """encode: a list of chunks to the ids of each, as the bytes of little-endian unsigned 32-bit
    numbers; a chunk after a cut begins with the joint."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], joint: str = " ",
                 whole: bool = False, memory: int = MEMORY) -> None:
        self.encode, self.joint, self.whole = encode, joint, whole
        self.careful = re.compile(rf"(?<=[^\s{joint}]){joint}(?=[^\s{joint}])")
        self.close = (joint * 2, joint + "\n", "\n" + joint)
        self.most = memory // ENTRY
        self.known: dict[str, bytes] = {}     # of chunks without the joint before them

    def parts(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        joint = self.joint
        if (text.endswith(joint) or any(c in text for c in self.close) or RARE_SPACE.search(text)):
            return self.careful.split(text)
        parts = text.split(joint)
        return parts if parts[0] or not text else [joint + parts[1], *parts[2:]]   # none at the start

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        known, rows, heads, fresh = self.known, [], [], set()
        for text in texts:
            parts = self.parts(text) if text else []
            heads.append(parts[0] if parts else "")
            ids = list(map(known.get, parts[1:]))
            rows.append((parts, ids))
            if None in ids:
                fresh.update(itertools.compress(parts[1:], map(not_, ids)))
        later = self.asked(list(fresh), [self.joint + p for p in fresh])
        out = []
        for head, ids, (parts, found) in zip(heads, self.encode(heads), rows):
            if None in found:
                found = [later[p] if own is None else own for p, own in zip(parts[1:], found)]
            out.append(np.frombuffer((ids if head else b"") + b"".join(found), "<u4"))
        self.remember(later)
        return out

    def of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts of a Cut; remembered with the space that others lack."""
        found = list(map(self.known.get, parts))
        new = [p for p, own in zip(parts, found) if own is None]
        later = self.asked(new, [self.joint + p[1:] if p[0] == " " else p for p in new])
        found = [later[p] if own is None else own for p, own in zip(parts, found)]
        self.remember(later)
        return found

    def asked(self, names: list[str], chunks: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        for at in range(0, len(names), 8192):
            found.update(zip(names[at:at + 8192], self.encode(chunks[at:at + 8192])))
        return found

    def remember(self, later: dict[str, bytes]) -> None:
        if len(self.known) + len(later) > self.most:
            self.known.clear()
        self.known.update((p, ids) for p, ids in itertools.islice(later.items(), self.most)
                          if len(p) <= LONGEST)


class Known(dict):
    """Texts and their ids. A missing one is encoded when it is asked for and remembered if it is
    short and of one line; a full memory starts anew."""

    def __init__(self, encode: Callable[[str], bytes], size: int) -> None:
        super().__init__()
        self.encode, self.most = encode, size // ENTRY

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        if len(text) <= LONGEST and "\n" not in text[:-1]:     # lines rarely meet twice
            if len(self) >= self.most:
                self.clear()
            self[text] = ids
        return ids


class SingleEncoder(ChunkedEncoder):
    """Like ChunkedEncoder, for an encoder of one chunk that gains nothing from many at once: `encode`
    has the ids of a chunk that begins with the joint, by what follows it. Chunks in which `special`
    occurs go to `library` instead, and are not remembered; nor may their texts be cut by Cut."""

    def __init__(self, encode: Callable[[str], bytes], first: Callable[[str], bytes],
                 special: re.Pattern, library: Callable[[str], bytes], memory: int) -> None:
        super().__init__(lambda chunks: list(map(first, chunks)))
        self.one, self.special, self.library = first, special, library
        self.known, self.bare = Known(encode, memory), Known(first, memory // 20)
        self.uncut = special.pattern

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            head, *rest = self.parts(text)
            if self.special.search(text):
                ids = [self.checked(head), *[self.checked(self.joint + part) for part in rest]]
            else:
                ids = [self.one(head), *map(self.known.__getitem__, rest)]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def of_cut(self, cut: Cut, rows: list[int]) -> dict[int, np.ndarray]:
        """By row, the ids of those of the rows that are cut."""
        known, bare = self.known, self.bare
        return cut.ids(rows, lambda parts: [known[p[1:]] if p[0] == " " else bare[p] for p in parts])

    def checked(self, chunk: str) -> bytes:
        return self.library(chunk) if self.special.search(chunk) else self.one(chunk)


def byte_level(path: str, memory: int = MEMORY) -> SingleEncoder:
    """A byte-level BPE file of the tokenizers library.

    Chunks go to the library's model directly: the file's own split of a text into words and its
    letters for bytes are applied here, which spares the library's bookkeeping of offsets. Chunks
    in which a string of the file's added tokens occurs go through the whole library, which gives
    such a string its own id.
    """
    import json

    import public_tokenizers
    import regex
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    if (split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True) or spec.get("normalizer")):
        raise ValueError("only byte-level files without a normaliser or prefix space")
    added = spec.get("added_tokens") or []
    if any(a["lstrip"] or a["rstrip"] or any(map(str.isspace, a["content"])) for a in added):
        raise ValueError("added tokens that hold or take white space are not supported")
    special = re.compile("|".join(re.escape(a["content"]) for a in added) or r"[^\s\S]")
    words = regex.compile(public_tokenizers.PATTERN)
    letters = byte_letters(pre_tokenizers)
    letter = [letters[byte] for byte in range(256)].__getitem__
    space, tokenize, number = letters[32], tokenizer.model.tokenize, attrgetter("id")

    def ids(word: str) -> bytes:
        if word.isascii() and word.isprintable():       # these stand for themselves but the space
            text = word.replace(" ", space)
        else:
            text = "".join(map(letter, word.encode()))
        return array("I", map(number, tokenize(text))).tobytes()

    # what stands beside words (punctuation, numbers) and the beginnings of lines are few; they are
    # remembered apart from chunks
    beside = Known(ids, memory // 20)

    def joined(parts: list[str]) -> bytes:
        """A part that begins with the joint is a chunk by itself, met with and without punctuation."""
        known = encoder.known
        return b"".join([known[p[1:]] if p[0] == " " and len(p) > 1 else beside[p] for p in parts])

    def encode(rest: str) -> bytes:
        if rest.isalpha():                              # the split knows this as one word
            if rest.isascii():
                return array("I", map(number, tokenize(space + rest))).tobytes()
            if max(rest) < FAR_LETTER:
                return ids(" " + rest)
        elif rest[-1:] in ENDS and rest[:-1].isalpha() and (rest.isascii() or max(rest) < FAR_LETTER):
            return encoder.known[rest[:-1]] + beside[rest[-1]]      # and this as two
        elif "\n" in rest and " " not in rest and not RARE_SPACE.search(rest):
            head, *lines = rest.split("\n")
            if head and all(lines):                     # a line feed between them is cut by itself
                line_feed = beside["\n"]
                return encoder.known[head] + b"".join([line_feed + starts[line] for line in lines])
        parts = words.findall(" " + rest)
        return ids(parts[0]) if len(parts) == 1 else joined(parts)

    def first(chunk: str) -> bytes:
        parts = words.findall(chunk)
        return ids(chunk) if len(parts) == 1 else joined(parts)

    starts = Known(first, memory // 20)

    def library(chunk: str) -> bytes:
        return array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    encoder = SingleEncoder(encode, first, special, library, 9 * memory // 10)
    return encoder


def byte_letters(pre_tokenizers) -> dict[int, str]:
    """The letter that byte-level files write for each byte: printable bytes stand for themselves,
    the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    found = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    if set(found.values()) != set(pre_tokenizers.ByteLevel.alphabet()):
        raise ValueError("the library uses other letters")
    return found
