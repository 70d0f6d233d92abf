"""Main text of HTML pages as the maximum-scoring subsequence of their words and tags.

Words score one, tags score below zero by how rarely they occur in the main text of the labelled pages. A word keeps
its score unless a logistic model of the elements around it (tag names, words of class, id and role), fitted on the
same pages, rejects the place; there tags cost the least, so that what is left out anyway does not part an article.
One scan finds the contiguous run of the largest sum; the blocks that it touches are the main text, without their
rejected parts.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .page_labels import PAGES

#: Elements whose content is not text of the page.
SKIPPED = "script style noscript template svg iframe object textarea select option button canvas math".split()
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small "
    "span strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Score of a place that nothing speaks against; of a tag that no labelled page has; the least that a tag costs.
PLAIN, UNKNOWN_TAG, LEAST_COST = 1.0, -0.5, 0.02
#: These say nothing about a place, and neither do inline elements.
NEUTRAL = {"html", "body", "div", "center"}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Values of class, id and role; the quoted values of other attributes are taken whole, as they may hold markup.
_NAMES = re.compile(
    r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|=\s*(?:"[^"]*"|'[^']*')""", re.I
)
#: Attributes with their values closed; one attribute up to its value, with the quote that opens it, or the tag's end.
_ATTRIBUTES = re.compile(
    r"""(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)|(?!\s*+=)))*+[\s/]*+"""
)
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(["']?))?+)?+""")
_UNQUOTED = re.compile(r"[^\s>]*+")
MARKS = re.compile(r"\{\{|\}\}")
_PART = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}
Token = tuple[str, str, tuple[str, ...]]  # kind (text, open, close), text or tag name, feature names


def named(attributes: str) -> tuple[str, ...]:
    parts: set[str] = set()
    for groups in _NAMES.findall(attributes):
        for part in _PART.findall("".join(groups).lower()):
            parts.add("." + (part[:-1] if len(part) > 3 and part.endswith("s") else part))
    return tuple(sorted(parts))


def tokens(page: str) -> Iterator[Token]:
    """Texts and tags in order; comments, declarations and skipped elements are left out. Linear in the page."""
    at, size, missing, ends = 0, len(page), set(), TagEnds(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ()
            return
        if start > at:
            yield "text", page[at:start], ()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(page, start)
        end = ends.find(start, tag.end()) if tag else -1
        if end < 0:
            if tag and page.find(">", start) < 0:  # no tag can follow
                yield "text", page[start:], ()
                return
            yield "text", "<", ()
            at = start + 1
            continue
        name, at, attributes = tag[1].lower(), end + 1, page[tag.end() : end]
        if page[start + 1] == "/":
            yield "close", name, ()
        elif name in _END and not attributes.endswith("/"):
            closing = _END[name].search(page, at) if name not in missing else None
            if closing:
                at = closing.end()
            elif name in ("script", "style"):
                at = size
            else:
                missing.add(name)
        else:
            yield "open", name, named(attributes) if attributes else ()


class TagEnds:
    """Where the tags of a page end: at the first > that is in no quoted value. Linear in the page.

    A quote opens a value only after =, and only if it is closed somewhere; else it is an ordinary character. A tag
    of which every > is in quoted values ends at the first > of all; the places that such a tag has led through are
    kept, so that no later tag follows them again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {quote: page.rfind(quote) for quote in "\"'"}
        self.dead: set[int] = set()

    def find(self, start: int, at: int) -> int:
        """The end of the tag at ``start``, whose name ends at ``at``; -1 if no > follows."""
        page, seen = self.page, []
        first = page.find(">", start)
        if first < 0 or _ATTRIBUTES.match(page, at, first).end() == first:
            return first
        while at < len(page) and at not in self.dead:
            seen.append(at)
            part = _ATTRIBUTE.match(page, at)
            at, quote = part.end(), part[2]
            if part[1]:
                return at - 1
            if quote and at <= self.last[quote]:
                at = page.find(quote, at) + 1
            elif quote is not None:
                at = _UNQUOTED.match(page, at).end()
        self.dead.update(seen)
        return first


class Places:
    """The open elements at a point of a page, each with the sum of the values of its own and outer features."""

    CLOSED_BY_BLOCK = {"p"}
    CLOSED_BY_SAME = {"li", "dt", "dd", "option", "tr", "td", "th"}

    def __init__(self, value, start):
        self.value = value
        self.stack: list[tuple[str, object]] = []
        self.start = start
        self.count: Counter[str] = Counter()

    @property
    def now(self):
        return self.stack[-1][1] if self.stack else self.start

    def drop(self, name: str) -> None:
        while True:
            gone, _ = self.stack.pop()
            self.count[gone] -= 1
            if gone == name:
                return

    def see(self, kind: str, name: str, features: tuple[str, ...]) -> None:
        if kind == "close":
            if self.count[name]:
                self.drop(name)
        elif name not in VOID:
            if name not in INLINE and self.count["p"]:
                self.drop("p")
            if name in self.CLOSED_BY_SAME and self.stack and self.stack[-1][0] == name:
                self.drop(name)
            own = features if name in NEUTRAL or name in INLINE else (name, *features)
            self.stack.append((name, self.value(self.now, own)))
            self.count[name] += 1


class MainText:
    def __init__(self, places: dict[str, float], tags: dict[str, float], scale: float):
        self.places, self.tags, self.scale = places, tags, scale

    def cost(self, name: str, features: tuple[str, ...]) -> float:
        least = min([self.tags.get(name, UNKNOWN_TAG), *(self.tags.get(f, 0.0) for f in features)])
        return min(self.scale * least, -LEAST_COST)

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        known = self.places
        here = Places(lambda outer, own: outer + sum(known.get(f, 0.0) for f in own), PLAIN)
        scores: list[float] = []
        parts: list[tuple[int, int, str | None]] = []  # block, place in scores, text (None: rejected)
        block = 0
        for kind, name, features in tokens(page):
            if kind == "text":
                text = html.unescape(name)
                n = len(text.split())
                main = here.now > 0
                parts.append((block, len(scores) if n else -1, text if main else None))
                if n:
                    scores.append(float(n) if main else 0.0)
                continue
            inside = here.now
            here.see(kind, name, features)
            scores.append(self.cost(name, features) if inside > 0 and here.now > 0 else -LEAST_COST)
            if name == "br":
                parts.append((block, -1, " "))
            elif name not in INLINE:
                block += 1
        if not scores:
            return ""
        total = np.concatenate([[0.0], np.cumsum(scores)])
        gain = total[1:] - np.minimum.accumulate(total[:-1])
        last = int(gain.argmax())
        if gain[last] <= 0:
            return ""
        first = int(total[: last + 1].argmin())
        chosen = {b for b, place, text in parts if text is not None and first <= place <= last}
        blocks: dict[int, list[str]] = defaultdict(list)
        for b, _, text in parts:
            if b in chosen and text is not None:
                blocks[b].append(text)
        joined = (" ".join("".join(found).split()) for _, found in sorted(blocks.items()))
        return "\n\n".join(b for b in joined if b)


def labelled() -> tuple[list[tuple[Counter, bool, int]], dict[str, list[int]]]:
    """Feature counts, label and words of each text of the labelled pages; per tag feature uses outside and inside."""
    texts, tags = [], defaultdict(lambda: [0, 0])
    for page in PAGES:
        inside = False
        here = Places(lambda outer, own: outer + Counter(own), Counter())
        for kind, name, features in tokens(page):
            if kind != "text":
                here.see(kind, name, features)
                for f in (name, *features):
                    tags[f][inside] += 1
                continue
            for part in re.split(r"(\{\{|\}\})", name):
                if part in ("{{", "}}"):
                    inside = part == "{{"
                elif part.split():
                    texts.append((here.now, inside, len(part.split())))
    return texts, tags


@cache
def trained(rounds: int = 1500, rate: float = 2.0, decay: float = 0.0005) -> MainText:
    """The logistic model by projected gradient descent over the texts, weighted by the root of their words.

    Features can only speak against a place, so no inner element makes a rejected one good. Tags score by their
    log-odds, times the largest scale that gives the most labelled pages back without a fault.
    """
    texts, tags = labelled()
    index = {f: i for i, f in enumerate(sorted({f for held, _, _ in texts for f in held}))}
    x = np.zeros((len(texts), len(index)))
    for row, (held, _, _) in enumerate(texts):
        for f, n in held.items():
            x[row, index[f]] = n
    y = np.array([inside for _, inside, _ in texts], dtype=float)
    share = np.sqrt([n for _, _, n in texts])
    share /= share.sum()
    w = np.zeros(len(index))
    for _ in range(rounds):
        miss = (1 / (1 + np.exp(-(x @ w + PLAIN))) - y) * share
        w = np.minimum(0.0, w - rate * (x.T @ miss + decay * w))
    places = {f: float(w[i]) for f, i in index.items()}
    scores = {f: -min(4.0, max(0.0, log((out + 0.5) / (inside + 0.5)))) for f, (out, inside) in tags.items()}

    def right(scale: float) -> int:
        model = MainText(places, scores, scale)
        return sum(model.text(MARKS.sub("", page)).split() == wanted_words(page) for page in PAGES)

    scale = max((right(s), s) for s in (0.1, 0.2, 0.3, 0.5, 0.7, 1.0))[1]
    return MainText(places, scores, scale)


def wanted_words(page: str) -> list[str]:
    inside = " ".join(re.findall(r"\{\{(.*?)\}\}", page, re.S))
    found = (html.unescape(t) if kind == "text" else "" if t in INLINE else " " for kind, t, _ in tokens(inside))
    return "".join(found).split()


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: MainText | None = None
) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of the text).

    Character references are decoded, white space inside a block is one space, blocks are joined by two line ends in
    page order. Null and empty pages and pages without words give the empty text; pages are read whole; null and
    repeated ids and urls are carried along. An empty table gives an empty result.
    """
    model = model or trained()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [model.text(page) for page in part.column("html").to_pylist()]
                arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
                arrays.append(pa.array([len(t) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
