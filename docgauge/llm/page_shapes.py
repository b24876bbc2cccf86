"""Pages of stuffed keywords, links or product tags.

Every line, and every sentence of a longer line, is reduced to a shape: the
class of its word count, how its words are capitalised, its separator, its
links, and the mark it ends with.  The lines of a page are put together by
shape, and each shape is judged as a whole: it is a shape of links, of tags,
of a bare listing, of stuffed keywords, or of sentences and records.  A page
is flagged if a few shapes of the first four kinds hold most of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of a page's words that such shapes must hold, how many shapes may
#: share in it, and the least number of words or of links in them.  Spam
#: repeats one pattern, or two or three; a page of many odd pieces is no spam.
DOMINATED = 0.5
FEW_SHAPES = 4
LEAST_WORDS = 12
LEAST_LINKS = 6
#: A shape of links has no more than so many other words for each link.
WORDS_A_LINK = 6
#: A shape reads as a listing up to this part of words that make sentences.
VERBAL = 0.08
#: A shape is stuffed if this part of its words are keywords where they stand.
#: A keyword recurs so often on the page, and holds this part of its words or
#: recurs as often in a stretch of so many words, or stands twice in the line.
STUFFED = 0.25
LEAST = 3
DENSITY = 0.03
STRETCH = 25
#: Lines of a shape that are the same words over and over: each stands so often on average.
REPEATED = 4

# Function words of English, French, German, Spanish.
_FUNCTION = frozenset(
    (
        "the a an of and or to in on for with by from at as is are was were be been it its this that these those not no "
        "your our you we i he she they his her their which who what when if but than then so all any only has have had "
        "will would can could may my us about after before between during until said also "
        "le la les un une des du de d l et ou à au aux en dans sur pour par avec sans est sont a été être ce cette ces "
        "qui que ne pas son sa ses leur nous vous il elle ils votre nos notre dont plus depuis mais "
        "der die das den dem des ein eine einen einem einer und oder zu zum zur im in am an auf für mit von vom bei aus "
        "nach ist sind war wurde wird werden nicht dass sich wir ihr ihre ihren es er sie als auch noch um so bis doch "
        "el la los las un una unos unas y o de del al a en con por para sin es son fue que se su sus no lo como más "
        "este esta estos nuestro le ha hasta desde pero"
    ).split()
)
#: Words that join the parts of a name: they do not make a sentence.
_JOINING = frozenset("de del des du d l la el à a en y et und of and & para pour für".split())
_SENTENCE = _FUNCTION - _JOINING
_PERSON = re.compile(r"\b[A-Z]\. ?[A-Z]")

# Endings of host names, and markup of links.
_TLD = frozenset("example test invalid com org net info biz shop edu gov eu us uk de fr es it io co".split())
_DOMAIN = re.compile(rf"\.(?:{'|'.join(sorted(_TLD))})\b")
#: Words of a host name that is written with "dot".
_SPELLED = 4
_EDGES = "()[]<>\"'.,;:!?«»„“”"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_TAG_LINE = re.compile(r"(?:tags|keywords|mots-clés|schlagwörter|stichwörter|etiquetas|palabras clave)\s?:", re.IGNORECASE)
#: Marks of genuine lists: initials, amounts, leaders, boxes, numbers in brackets, fields.
_RECORD = re.compile(r"\b[A-Z]\. ?[A-Z]|\d[.,]\d|[$€£@=]|\bn\.d\.|\.{3}|^\[\d{1,9}\]|\[[ xX]?\]|^[^:|>/]{2,30}:(?!//)")
_END = re.compile(r"[.!?]\s+")
_SEPARATOR = re.compile(r"[|•·»>/;,*]| - ")


def _is_record(line: str) -> bool:
    """Whether a line bears a mark of a genuine list, or ends as a sentence or with a page number."""
    if line[-1] in ".!?:" or _RECORD.search(line):
        return True
    bare = line.rstrip("0123456789")
    if 1 <= len(line) - len(bare) <= 4:
        gap = bare.rstrip()
        return gap.endswith((",", "..")) or len(bare) - len(gap) >= 2
    return False


def _may_link(low: str) -> bool:
    return "://" in low or "www" in low or "[.]" in low or "(.)" in low or _DOMAIN.search(low) is not None


def _is_link(token: str) -> bool:
    if "://" in token or token.startswith("www."):
        return True
    if "." not in token:
        return False
    host = token.replace("[.]", ".").replace("(.)", ".").strip(_EDGES).partition("/")[0].partition("?")[0]
    name, _, end = host.rpartition(".")
    return end in _TLD and name != "" and name[-1].isalnum()


def _without_links(line: str) -> tuple[int, int, list[str]]:
    """(links, words they are written in, other words) of a line in lower case."""
    tokens = line.replace(">", "> ").replace("<", " <").replace("](", "] (").split()
    links, linked, rest, at = 0, 0, [], 0
    while at < len(tokens):
        token, size = tokens[at], 0
        if _is_link(token):
            size = 1
        elif token == "www":
            size = next((j + 2 - at for j in range(at + 2, min(at + 2 + _SPELLED, len(tokens) - 1)) if tokens[j] == "dot"), 0)
        if size:
            links, linked = links + 1, linked + size
        elif token not in ("<a", "</a>"):
            rest.append(token)
        at += max(1, size)
    return links, linked, _WORD.findall(" ".join(rest))


def _capitals(line: str, low: str) -> str:
    if line == low:
        return "none"
    if line[1:] == low[1:]:
        return "first"
    return "upper" if line.isupper() else "each" if line.istitle() else "some"


class _Shape:
    """The lines of one shape and sums over them."""

    __slots__ = ("links", "linked", "lines", "tags", "verbal", "words")

    def __init__(self) -> None:
        self.lines: list[tuple[str, list[str], int]] = []
        self.links = self.linked = self.tags = self.verbal = self.words = 0

    def kind(self) -> str | None:
        """link, tag, list or repeated; None for sentences and records."""
        if self.links and self.words - self.linked <= WORDS_A_LINK * self.links:
            return "link"
        if 2 * self.tags >= self.words:
            return "tag"
        if self.verbal <= VERBAL * self.words:
            if 2 * sum(size for line, _, size in self.lines if _is_record(line)) < self.words:
                return "list"
            if REPEATED * len({" ".join(words) for _, words, _ in self.lines}) <= len(self.lines):
                return "repeated"
        return None


def _sentences(row: str) -> list[str]:
    """A line cut after the ends of its sentences; an initial or the number of an entry ends none."""
    parts, start = [], 0
    for end in _END.finditer(row):
        at = end.start()
        initial = row[at] == "." and at and row[at - 1].isupper() and (at < 2 or not row[at - 2].isalnum())
        if not initial and not (at - start <= 4 and row[start:at].isdigit()):
            parts.append(row[start : at + 1])
            start = end.end()
    parts.append(row[start:])
    return parts


def page_shapes(text: str) -> tuple[dict[tuple, _Shape], list[tuple[list[str], _Shape]]]:
    """The shapes of a page, and the words and the shape of each line or sentence.

    A link counts as the words it is written in.
    """
    shapes: dict[tuple, _Shape] = {}
    lines: list[tuple[list[str], _Shape]] = []
    may_link = _may_link(text.lower())
    for row in text.split("\n"):
        row = row.strip()
        tags = _TAG_LINE.match(row) is not None
        for line in _sentences(row):
            low = line.lower()
            if may_link and _may_link(low):
                links, linked, words = _without_links(low)
            else:
                links, linked, words = 0, 0, _WORD.findall(low)
            size = len(words) + linked
            if not size:
                continue
            cuts = _SEPARATOR.findall(line)
            cut = cuts[0] if cuts and cuts.count(cuts[0]) == len(cuts) else Counter(cuts).most_common(1)[0][0] if cuts else ""
            key = (min(size, 64).bit_length(), _capitals(line, low), cut, min(links, 2), line[-1] if line[-1] in ".!?:" else "")
            shape = shapes.get(key)
            if shape is None:
                shape = shapes[key] = _Shape()
            shape.lines.append((line, words, size))
            shape.words += size
            shape.links += links
            shape.linked += linked
            shape.verbal += len([w for w in words if w in _SENTENCE])
            if tags or ("#" in line and 2 * line.count("#") >= len(line.split())):
                shape.tags += size
            lines.append((words, shape))
    return shapes, lines


def _keywords(lines: list[list[str]], often: set[str]) -> set[str]:
    """Words that recur in changing company, as in stuffed text.

    In a phrase that is merely repeated every word keeps its neighbours; all
    numbers are one neighbour.
    """
    left: dict[str, set[str]] = {w: set() for w in often}
    right: dict[str, set[str]] = {w: set() for w in often}
    for said in lines:
        if not often.isdisjoint(said):
            words = ["", *("#" if w.isdigit() else w for w in said), ""]
            for before, word, after in zip(words, words[1:], words[2:]):
                if word in often:
                    left[word].add(before)
                    right[word].add(after)
    return {w for w in often if len(left[w]) >= 3 or len(right[w]) >= 3}


def _hits(lines: list[list[str]], keywords: set[str], wide: set[str]) -> list[int]:
    """How many words of each line are keywords where they stand.

    A keyword counts where it is among the words of ``wide``, stands ``LEAST``
    times within ``STRETCH`` words, or twice in the line.
    """
    at: dict[str, list[int]] = {w: [] for w in keywords - wide}
    place = 0
    for words in lines:
        for w in words:
            if w in at:
                at[w].append(place)
            place += 1
    close: set[int] = set()
    for places in at.values():
        for first, second, third in zip(places, places[1:], places[2:]):
            if third - first < STRETCH:
                close.update((first, second, third))
    hits, place = [], 0
    for words in lines:
        count = Counter(w for w in words if w in at)
        hits.append(sum(w in wide or count[w] > 1 or place + k in close for k, w in enumerate(words) if w in keywords))
        place += len(words)
    return hits


def _stuffed(lines: list[tuple[list[str], _Shape]], total: int, missing: float) -> list[_Shape]:
    """The shapes that are stuffed with keywords; none where they cannot hold ``missing`` words.

    A stuffed shape has keywords in ``STUFFED`` of its words, so all recurring
    words together bound what stuffed shapes can hold.
    """
    said = [words for words, _ in lines]
    count = Counter(chain.from_iterable(said))
    often = {w for w, n in count.items() if n >= LEAST and len(w) > 2 and w not in _FUNCTION and not w.isdigit()}
    if sum(map(count.__getitem__, often)) < STUFFED * missing:
        return []
    keywords = _keywords(said, often)
    held: Counter = Counter()
    for (_, shape), n in zip(lines, _hits(said, keywords, {w for w in keywords if count[w] >= DENSITY * total})):
        held[shape] += n if n >= 2 else 0
    return [
        shape
        for shape, n in held.items()
        if n >= STUFFED * shape.words and 2 * sum(size for line, _, size in shape.lines if "[" in line or _PERSON.search(line)) < shape.words
    ]


def is_stuffed(text: str | None, *, few: int = FEW_SHAPES) -> bool:
    """Whether at most ``few`` non-sentence shapes hold most words of the page."""
    if not text:
        return False
    shapes, lines = page_shapes(text)
    total = sum(shape.words for shape in shapes.values())
    found = {shape for shape in shapes.values() if shape.kind()}

    def largest() -> list[_Shape]:
        return sorted(found, key=lambda shape: -shape.words)[:few]

    held = sum(shape.words for shape in largest())
    if held < DOMINATED * total:
        found.update(_stuffed(lines, total, DOMINATED * total - held))
        held = sum(shape.words for shape in largest())
    return held >= DOMINATED * total and (held >= LEAST_WORDS or sum(shape.links for shape in largest()) >= LEAST_LINKS)


def stuffed_pages(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """The ``page_id`` of each page dominated by keywords, links or tags.

    One row for each row of ``pages`` that is a case, so copies of a case are
    cases.  Null, blank and very short texts are none.  A page is judged by
    itself and as a whole: there is no shuffle.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[is_stuffed(t) for t in batch[text]], [page_id]]

    kept = pages.select(page_id, text).where(F.col(text).isNotNull())
    return kept.mapInPandas(judge, f"`{page_id}` {pages.schema[page_id].dataType.simpleString()}")
