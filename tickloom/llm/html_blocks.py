"""Main text of web pages by two passes over their blocks.

A page is read as a stream of tags. Scripts, styles and the like are left out. The rest falls into
blocks at block-level tags. Pass one labels a block by its share of link text, its length and its
share of stop words, wherever it stands: good, bad, or undecided if it is short or, inside an
article, if nothing speaks against it. There are lists of stop words for four languages; where none
fits, length and links alone decide. Pass two gives each undecided block the label of the nearest
decided block of its own region. A region without any decided block is bad outside articles; inside
one it is good, unless the page's good text outside of articles is longer than all text in them:
then these are teasers.

Menus, headers, footers, sidebars, forms and elements whose class, id or role names an advert, a
notice, comments and the like are marked. What stands in them counts only on a page without good
text outside of marks (a page wrapped in a form, a menu never closed), and there only if most of it,
links aside, is good blocks, and these are longer than what the other marks hold. Where the mark is
one that stories bear too, long good text is enough, on pages without an article of good text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import forget, pieces, text_or_empty

#: The inside of a tag. A tag ends at the next `<` if no `>` comes before, so broken markup is read
#: in time that grows with its length alone.
INSIDE = r"(?:[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|title)(?=[\s/>])" + INSIDE
    + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*+(?:>|(?=<)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>" + INSIDE + r")(?:>|(?=<)|\Z)",
    re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))",
                       re.I)
SPACE = re.compile(r"\s+")
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu
    nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split())
MARKED = frozenset("nav header footer aside form button select dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
#: Parts of class, id and role values that name a region seldom with article text.
NAMES = frozenset("""ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment
    comments consent contentinfo cookie cookies dialog disqus footer gdpr header legal masthead menu
    modal nav navbar navigation navigator newsletter notice notices overlay pagination paywall popup
    promo promoted promotion recommend recommended related replies reply respond search share sharing
    sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets
    """.split())
#: Those that stories bear too, as topics or for their layout.
WEAK = frozenset("header legal notice notices paywall related search social tags".split())
#: Begin the names of a region's state (has-sidebar), which say nothing of its text.
STATES = re.compile(r"(?:has|is|no|not|with|without)[-_]")
#: Frequent function words: fixed lists of plain words, one a language.
LISTS = tuple(frozenset(words.split()) for words in ("""
    the of and to in is that for it as was with be by on not he this are or his from at which but have
    an had they you were their one all we can her has there been if more when will would who so no
    """, """
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden
    aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur
    in was
    """, """
    le la les de des du et un une est en que qui dans pour pas au sur ne se ce il par plus avec son
    aux sont mais ou cette
    """, """
    el los las del y una por con no para su al lo como más pero sus este ha si sobre entre cuando sin
    de la que en un se le es
    """))
STOP_WORDS = frozenset().union(*LISTS)
LETTERS = re.compile(r"[^\W\d_]+")
#: Signs that hold as much as two letters or more.
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
LATIN_END = "\u024f"
PROSE = 280         # characters of good blocks that free a region from a weak mark
SHORT, FEW_LINKS, MANY_LINKS, STOPS_LOW, STOPS_HIGH = 70, 0.2, 0.4, 0.1, 0.25
#: The share of words of one list from which on that list fits a page.
FITS = 0.15
GOOD, BAD, UNDECIDED = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int         # characters inside links
    region: int         # blocks of one region inherit from each other
    article: bool
    mark: int           # the innermost mark it stands in, -1 for none
    label: int = UNDECIDED


@dataclass
class Mark:
    tag: str
    parent: int         # the mark around it, -1 for none
    weak: bool
    depth: int = 1


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The blocks of a page, in order, and the marks they stand in."""
    found: list[Block] = []
    marks: list[Mark] = []
    around: list[int] = []                  # the open marks
    by_tag: dict[str, list[int]] = {}       # the same by their tags
    text: list[str] = []
    linked = region = article_depth = svg_depth = foreign = 0
    link = False

    def flush() -> None:
        nonlocal linked
        joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            found.append(Block(joined, linked, region, article_depth > 0,
                               around[-1] if around else -1))
        text.clear()
        linked = 0

    def end_mark() -> None:
        nonlocal region
        flush()
        by_tag[marks[around.pop()].tag].pop()
        region += 1

    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at and not svg_depth:
            piece = page[at:match.start()]
            text.append(piece)
            linked += len(piece.strip()) if link else 0
        at = match.end()
        tag = match["tag"]
        if tag is None:
            if match["data"] is not None and not svg_depth:
                text.append(html.escape(match["data"]))
            continue
        tag, closing = tag.lower(), bool(match["close"])
        closed = match["rest"].rstrip().endswith("/")
        if svg_depth and tag in BLOCK and not closing and not foreign:
            svg_depth = 0                   # a drawing never closed ends where text goes on
        if tag == "svg" or svg_depth:
            if tag == "svg" and not closed:
                svg_depth = max(svg_depth + (-1 if closing else 1), 0)
                foreign = foreign if svg_depth else 0
            elif tag == "foreignobject" and not closed:
                foreign = max(foreign + (-1 if closing else 1), 0)
            continue
        if tag == "a":
            link = not closing
        elif tag == "br":
            text.append(" ")
        if tag in BLOCK:
            flush()
            link = False
            if not closing and by_tag.get("p"):
                while by_tag["p"]:          # a paragraph ends where a block begins
                    end_mark()
        same = by_tag.get(tag)
        if closing:
            if same:
                marks[same[-1]].depth -= 1
                if marks[same[-1]].depth == 0:
                    last = same[-1]
                    while around and around[-1] >= last:
                        end_mark()
            if tag in ARTICLE and article_depth:
                flush()
                article_depth -= 1
                region += 1
        elif tag not in VOID:
            mark = _mark(tag, match["rest"], article_depth > 0)
            if tag in ARTICLE and mark is None:
                while around and marks[around[-1]].tag not in ARTICLE:
                    end_mark()              # a menu or advert ends where the article begins
            if mark is not None and not closed:
                flush()
                marks.append(Mark(tag, around[-1] if around else -1, mark))
                around.append(len(marks) - 1)
                by_tag.setdefault(tag, []).append(len(marks) - 1)
                region += 1
            elif same and not closed:
                marks[same[-1]].depth += 1
            if tag in ARTICLE:
                article_depth += 1
                region += 1
    if at < len(page) and not svg_depth:
        text.append(page[at:])
    flush()
    return found, marks


def _mark(tag: str, rest: str, in_article: bool) -> bool | None:
    """Whether an element's mark is a weak one; None without a mark."""
    if tag in MARKED and tag != "form" and not (tag == "header" and in_article):
        return False
    names: set[str] = set()
    if tag not in ("html", "body", "main"):
        for match in ATTRIBUTE.finditer(rest):
            for value in (match[1] or match[2] or match[3] or "").lower().split():
                if not STATES.match(value):
                    names.update(re.split(r"[^a-z]+", value))
        names &= NAMES
    return names <= WEAK if names or tag == "form" else None


def free(found: list[Block], marks: list[Mark], weak_only: bool) -> list[bool]:
    """Per mark whether the blocks in it count as those outside; weak_only: there is good text."""
    fits = listed(found)
    own, plain = [0] * len(marks), [0] * len(marks)     # good text and all, links aside
    for block in found:
        if block.mark >= 0 and block.linked <= MANY_LINKS * len(block.text):
            plain[block.mark] += len(block.text)
            if block.linked <= FEW_LINKS * len(block.text) and first_pass(block, fits, SHORT) == GOOD:
                own[block.mark] += len(block.text)
    within, rivals, most = own[:], [0] * len(marks), {}
    for i in reversed(range(len(marks))):
        if marks[i].parent >= 0:
            within[marks[i].parent] += within[i]
        most[marks[i].parent] = max(most.get(marks[i].parent, 0), within[i])
    prose, out = own[:], [False] * len(marks)
    for i, mark in enumerate(marks):
        if mark.parent >= 0:
            rivals[i] = rivals[mark.parent] + own[mark.parent]
    for i in reversed(range(len(marks))):
        mark, enough = marks[i], max(prose[i], 1) * 2 >= plain[i]
        longest = prose[i] >= 2 * SHORT and prose[i] > rivals[i] and within[i] == most[mark.parent]
        out[i] = enough and (longest and not weak_only or mark.weak and prose[i] >= PROSE)
        if out[i] and mark.parent >= 0:
            prose[mark.parent] += prose[i]
            plain[mark.parent] += plain[i]
    for i, mark in enumerate(marks):
        out[i] = out[i] and (mark.parent < 0 or out[mark.parent])
    return out


def listed(found: list[Block]) -> bool:
    """Whether one of the lists fits the page's words in Latin letters outside of links, and blocks
    with hardly a word of any list are not the longer part of them."""
    all_words: list[str] = []
    known = strange = 0
    for block in found:
        if block.linked <= MANY_LINKS * len(block.text):
            words = [w for w in LETTERS.findall(block.text.lower()) if w <= LATIN_END]
            all_words += words
            if sum(w in STOP_WORDS for w in words) < STOPS_LOW * len(words):
                strange += len("".join(words))
            else:
                known += len("".join(words))
    return strange <= known and any(
        sum(w in stops for w in all_words) > FITS * len(all_words) for stops in LISTS)


def first_pass(block: Block, fits: bool, long: int = 2 * SHORT) -> int:
    """The label; where no list can speak of a block (none fits the page, or its words are not in
    Latin letters), it is good if it is long and has few links."""
    size = room = len(block.text)
    if block.linked > MANY_LINKS * size:
        return BAD
    if not block.text.isascii():
        room += len(WIDE.findall(block.text))
    if room < SHORT:
        return UNDECIDED
    words = LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= STOPS_HIGH or stops >= STOPS_LOW and size >= 2 * SHORT:
        return GOOD
    if words and (not fits or 2 * sum(w > LATIN_END for w in words) > len(words)):
        return GOOD if room >= long and block.linked <= FEW_LINKS * size else UNDECIDED
    return UNDECIDED if block.article or stops >= STOPS_LOW else BAD


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided one of their region; between two as
    near, good wins."""
    story = sum(len(b.text) for b in found if b.label == GOOD and not b.article)
    teasers = story > sum(len(b.text) for b in found if b.label != BAD and b.article)
    start = 0
    while start < len(found):
        end = start
        while end < len(found) and found[end].region == found[start].region:
            end += 1
        group = found[start:end]
        decided = [(i, b.label) for i, b in enumerate(group) if b.label != UNDECIDED]
        at = 0
        for i, block in enumerate(group):
            if block.label != UNDECIDED:
                continue
            while at < len(decided) and decided[at][0] < i:
                at += 1
            near = [(abs(j - i), -label) for j, label in decided[max(at - 1, 0):at + 1]]
            block.label = (-min(near)[1] if near else
                           GOOD if block.article and not teasers else BAD)
        start = end


def label(found: list[Block]) -> list[Block]:
    """Both passes; the good blocks."""
    fits = listed(found)
    for long in (2 * SHORT, SHORT):     # where all paragraphs are short, the longer of them count
        for block in found:
            block.label = first_pass(block, fits, long)
        if any(b.label == GOOD for b in found):
            break
    second_pass(found)
    return [b for b in found if b.label > 0]


def main_text(page: str) -> str:
    """The good blocks, joined by line feeds."""
    found, marks = blocks(page)
    good = label([b for b in found if b.mark < 0])
    if not any(b.article for b in good):
        freed = free(found, marks, bool(good))
        good = label([b for b in found if b.mark < 0 or freed[b.mark]])
    return "\n".join(b.text for b in good)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars (its code points).

    Null or empty html, and pages without a good block, have an empty text. Whole pages are read,
    however long; repeated rows are answered alike; an empty table stays empty. Other columns pass
    through, but for text and n_chars, which are replaced.
    """
    others = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for low, high in pieces(batch, "__html", 1 << 22):
                some = batch.slice(low, high - low)
                texts = [main_text(p) for p in some.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(n) for n in names]
                    + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[*names, "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*others, T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    return pages.select(*names, text_or_empty(html_col).alias("__html")).mapInArrow(run, schema)
