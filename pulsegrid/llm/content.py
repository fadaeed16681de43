"""Main-text extraction by a maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word's weight is the log-odds of being main
text, summed over the open elements around it and the words of their class, id and
role; it is learnt from labelled pages, where an article or main element marks the main text
(these marks are not features, so pages without them are judged by the same weights).
Every tag has one negative weight, small enough that labelled main text stays positive.
One linear scan finds the contiguous run with the largest sum. Inside it, text in
elements that are never main text (``SKIPPED``, and blocks marked by a word of ``NOISE``) is left out. A form or a
marked element is a mere wrapper, and its mark has no effect, for an article or main element inside it, and
where it holds more than ``WRAPPED`` of the page's words. Words of ``HINTS`` only weigh, neither on such wrappers nor inside labelled main text.
Inline elements, headings and what lies in ``pre`` or ``code`` are never marked, save an inline advert outside paragraphs;
a section is marked only by a class, id or role that is such a word as a whole, or by a word of ``PLAIN_NOISE``.

Tags are read in one pass that never goes back, so time grows with the page's length, also where tags or quotes are not
closed. An element more than ``DEPTH`` levels down counts as part of the last one.

The weights are fitted on a sample of about ``labelled_pages`` pages, chosen by a hash of
the page and its id, counted in Spark with one row per feature; the number of features kept is bounded by
``max_features``, the most frequent ones. Prior counts for the fixed lists stand in where no page is labelled.

Null html is empty. Repeated rows get equal results. Columns other than ``page_id``,
``url`` and ``html`` are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import clean, map_frames, text_batches

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo mrow ms msub msup msubsup mtext mfrac msqrt svg text tspan".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
LABELS = frozenset(["article", "main"])
#: Elements whose text is never main text.
SKIPPED = frozenset(
    "head script style noscript template textarea iframe object nav aside footer form select option dialog menu title canvas audio video".split()
)
#: Words of class, id and role that mark a block as one of a menu, header, footer, sidebar, notice, advert, form or reader comments.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "comment comments commentlist disqus cookie cookies consent notice notices notification popup modal newsletter subscribe subscription signup login "
    "share sharing social toolbar complementary contentinfo".split()
)
#: Those with no other meaning, and those of adverts.
PLAIN_NOISE = frozenset("adverts advertisement advertising sponsored sidebar navbar breadcrumbs comments commentlist disqus cookies newsletter contentinfo".split())
ADVERT = frozenset("ad ads adsbygoogle advert adverts advertisement sponsored".split())
#: Words that speak against main text but do not mark a block.
HINTS = frozenset("related recommended widget search".split())
#: Elements whose own class, id and role never mark them, besides the inline ones.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 pre figure figcaption blockquote table thead tbody tr td th".split())
#: Elements that may wrap a whole page, and the share of its words from which on a marked element does.
SOFT = frozenset(["form"])
WRAPPED = 2 / 3
#: Prior counts of words for the lists above, and for elements of running text.
PRIOR = 50.0
RUNNING = frozenset("p h1 h2 h3 blockquote pre".split())
MAX_FEATURES = 20_000
LABELLED_PAGES = 10_000
LARGEST = 4.0
#: Open elements that count one by one.
DEPTH = 256

_OPENS = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_PLAIN = re.compile(r"[^>\"']*+")
_MARK = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_WORD = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}


class Piece(NamedTuple):
    """A text between two tags, character references as they are (or a tag: text is None)."""

    text: str | None
    features: tuple[str, ...]
    main: bool  # inside a labelled element
    noise: bool  # inside an element that is never main text
    block: bool  # a tag that ends a block


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str  # empty: a comment, declaration or the like
    attrs: str


def tags(page: str) -> Iterator[Tag]:
    """Tags of a page in order; the caller may send a place to go on from.

    A ``>`` inside quotes does not end a tag, unless the quotes or the tag would never end: then the next ``>`` does.
    ``stuck`` holds the opening quotes from which no end was found, so none is followed twice.
    """
    last = page.rfind(">")
    stuck: set[int] = set()
    at = 0
    while m := _OPENS.search(page, at):
        comment, data, other, slash, name = m.groups()
        at = m.end()
        if name is None:
            close = "-->" if comment else "]]>" if data else ">"
            stop = page.find(close, at) if at <= last else -1
            at = len(page) if stop < 0 else stop + len(close)
            yield Tag(m.start(), at, False, "", "")
            continue
        if at > last:
            return
        stop, met = _PLAIN.match(page, at).end(), []
        while stop < len(page) and page[stop] != ">":
            met.append(stop)
            closing = -1 if stop in stuck else page.find(page[stop], stop + 1)
            stop = len(page) if closing < 0 else _PLAIN.match(page, closing + 1).end()
        if stop == len(page):
            stuck.update(met)
            stop = page.find(">", at)
        at = (yield Tag(m.start(), stop + 1, bool(slash), name.lower(), page[at:stop])) or stop + 1


class _Words(NamedTuple):
    features: tuple[str, ...]
    noise: bool  # its words mark it, were it a block
    plain: bool  # they do on a section too
    advert: bool
    hint: bool


def _words(name: str, attrs: str) -> _Words:
    values = [v for m in _MARK.finditer(attrs) for v in (m[1] or m[2] or m[3] or "").lower().split()] if "=" in attrs else []
    words = {w for v in values for w in _WORD.findall(v)}
    return _Words(
        (name, *sorted("." + w for w in words)),
        not words.isdisjoint(NOISE),
        not words.isdisjoint(PLAIN_NOISE) or not NOISE.isdisjoint(values),
        not ADVERT.isdisjoint(values),
        not words.isdisjoint(HINTS),
    )


def _is_marked(words: _Words, here: _Place) -> bool:
    name = words.features[0]
    if name in SOFT:
        return True
    if not (words.noise or words.advert) or "pre" in here.features or "code" in here.features:
        return False
    if name in INLINE:
        return words.advert and name != "code" and not here.paragraphs
    return name not in HEADINGS and (words.plain if name == "section" else words.noise)


class _Place(NamedTuple):
    """What surrounds a text: features, whether it is labelled main text, whether it never is main text, open paragraphs, places of open marked elements (of those with hints: minus one, minus the place)."""

    features: tuple[str, ...] = ()
    main: bool = False
    skipped: bool = False
    paragraphs: int = 0
    marks: tuple[int, ...] = ()

    @property
    def noise(self) -> bool:
        return self.skipped or any(mark >= 0 for mark in self.marks)

    def inside(self, features: tuple[str, ...], role: bool, mark: int | None, lifted: bool) -> _Place:
        """Within an element; ``mark`` is its place if it is marked, ``lifted`` says that it is a wrapper all the same."""
        name = features[0]
        label = name in LABELS or role and ".main" in features
        skipped = name in SKIPPED - SOFT or name == "header" and not self.main
        outer, marks = self.features, self.marks
        if label:
            outer, marks = tuple(f for f in outer if not _marked(f)), ()
        if lifted or name in LABELS:
            features = tuple(f for f in features if not _marked(f))
        elif mark is not None:
            marks = (*marks, mark)
        return _Place(
            tuple(dict.fromkeys((*outer, *(f for f in features if f not in LABELS)))),
            self.main or label,
            self.skipped or (skipped and name not in LABELS),
            self.paragraphs + (name == "p"),
            marks,
        )


def _marked(feature: str) -> bool:
    return feature in SOFT or feature[0] == "." and (feature[1:] in NOISE or feature[1:] in HINTS)


def pieces(page: str | None) -> Iterator[Piece]:
    """Texts and tags of a page in order."""
    found = list(_scan(page or "", frozenset()))
    held: Counter = Counter()
    total = 0
    for p, place in found:
        if p.text is not None and not place.skipped:
            n = len(p.text.split())
            total += n
            for mark in place.marks:
                held[mark] += n
    lifted = frozenset(mark for mark, n in held.items() if n > WRAPPED * total)
    return (p for p, _ in (_scan(page or "", lifted) if lifted else found))


def _scan(page: str, lifted: frozenset[int]) -> Iterator[tuple[Piece, _Place]]:
    """Pieces with their places, where elements that begin at ``lifted`` are wrappers."""
    names: list[str] = []
    places = [_Place()]
    open_names: Counter = Counter()
    known: dict[tuple, tuple[_Place, _Place]] = {}  # by the outer place's id, and with that place, so that the id stays its own
    at, go_on = 0, None
    found = tags(page)

    def close(name: str) -> None:
        while True:
            last = names.pop()
            places.pop()
            open_names[last] -= 1
            if last == name:
                return

    while True:
        try:
            tag = found.send(go_on)
        except StopIteration:
            tag = None
        go_on = None
        end = tag.start if tag else len(page)
        here = places[-1]
        if end > at:
            yield Piece(page[at:end], here.features, here.main, here.noise, False), here
        if not tag:
            return
        at, name = tag.end, tag.name
        if not name:
            continue
        if tag.closing:
            if open_names[name]:
                close(name)
        else:
            if name in CLOSES_P and open_names["p"]:
                close("p")
            if name in RAW:
                stop = _END[name].search(page, at)
                at = go_on = stop.end() if stop else len(page)
            elif name not in VOID:
                outer = places[-1]
                if len(places) <= DEPTH:
                    words = _words(name, tag.attrs)
                    role = "role" in tag.attrs
                    mark = tag.start if _is_marked(words, outer) else -1 - tag.start if words.hint else None
                    key = (id(outer), words, role, mark)
                    if key not in known:
                        known[key] = outer, outer.inside(words.features, role, mark, mark in lifted)
                    outer = known[key][1]
                names.append(name)
                places.append(outer)
                open_names[name] += 1
        here = places[-1]
        yield Piece(None, here.features, here.main, here.noise, name not in INLINE), here


def word_counts(pages: DataFrame) -> DataFrame:
    """(feature, inside, outside): words of labelled pages by open element, '' for all words and '<' for tags."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for page in clean(b["html"]):
                found = list(pieces(page))
                if not any(p.main for p in found):
                    continue
                for p in found:
                    if p.text is None:
                        seen[p.main]["<"] += 1
                    elif n := len(p.text.split()):
                        for f in ("", *p.features):
                            seen[p.main][f] += n
            names = list(seen[True] | seen[False])
            yield pd.DataFrame({"feature": names, "inside": [seen[True][f] for f in names], "outside": [seen[False][f] for f in names]})

    text_batches(pages.sparkSession)
    each = map_frames(pages.select(F.col("html").cast("string").alias("html")), count, "feature string, inside bigint, outside bigint")
    return each.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


class Weights(NamedTuple):
    base: float
    feature: dict[str, float]
    tag: float

    def word(self, features: tuple[str, ...], main: bool = False) -> float:
        if main:
            features = tuple(f for f in features if f[1:] not in HINTS)
        return max(-LARGEST, min(LARGEST, self.base + sum(self.feature.get(f, 0.0) for f in features)))

    def of(self, pieces_: list[Piece]) -> list[float]:
        """Weight of every piece. Text that is left out anyway costs what one word may cost, so it does not cut an article."""
        known: dict[tuple, float] = {}
        out = []
        for p in pieces_:
            n = 0 if p.text is None else len(p.text.split())
            key = (id(p.features), p.main)
            if n and key not in known:
                known[key] = self.word(p.features, p.main)
            w = n * known[key] if n else self.tag if p.text is None else 0.0
            out.append(max(-LARGEST, min(w, self.tag)) if n and p.noise else w)
        return out


def learn(pages: DataFrame, labelled_pages: int = LABELLED_PAGES, max_features: int = MAX_FEATURES) -> Weights:
    """Weights from a bounded sample of pages; at most ``max_features`` features come to the driver."""
    share = min(1.0, labelled_pages / max(1, pages.count()))
    chosen = F.pmod(F.xxhash64("page_id", "html"), F.lit(1_000_000)) < int(share * 1_000_000)
    top = word_counts(pages.where(chosen)).orderBy(F.col("feature").isin("", "<").desc(), (F.col("inside") + F.col("outside")).desc(), "feature").limit(max_features)
    counts = {r["feature"]: (r["inside"], r["outside"]) for r in top.collect()}
    inside, outside = (x + 1.0 for x in counts.pop("", (0, 0)))
    tags, _ = counts.pop("<", (0, 0))
    base = max(0.0, min(1.0, math.log(inside / outside)))
    feature = {}
    for f in set(counts) | SKIPPED | RUNNING | {"." + w for w in NOISE | HINTS}:
        a, b = counts.get(f, (0, 0))
        a += 0.5 + PRIOR * (f in RUNNING)
        b += 0.5 + PRIOR * (f in SKIPPED or f[1:] in NOISE | HINTS and f[0] == ".")
        feature[f] = math.log(a / b) - math.log((inside + PRIOR) / (outside + PRIOR))
    return Weights(base, feature, -0.25 * min(1.0, inside / (tags + 1.0)))


def main_text(page: str | None, weights: Weights) -> str:
    """The best contiguous run of a page, without what is never main text."""
    found = list(pieces(page))
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, w in enumerate(weights.of(found)):
        total += w
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, begin, end = total, start, i + 1
    out = []
    for p in found[begin:end]:
        if p.text is None:
            if p.block:
                out.append(" ")
        elif not p.noise:
            out.append(html.unescape(p.text))
    return " ".join("".join(out).split())


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text) of every page."""
    weights = learn(pages) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [main_text(t, weights) for t in clean(b["html"])]})

    picked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_frames(picked, run, "page_id bigint, url string, text string")
