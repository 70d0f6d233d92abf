"""License scans by template matching: optional and replaceable regions compiled into automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_templates import PHRASES, TEMPLATES
from .terms import words_of

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;\d+-\d+|one;[^>]*)>>")


class Template:
    """A word automaton. State i has edges (word or None for any word, next state) and free moves to other states."""

    def __init__(self, label: str, source: str):
        self.label = label
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.runs: list[list[bytes]] = [[]]  # runs of mandatory words
        depth, opened, last = 0, [], 0
        for mark in [*_MARKUP.finditer(source), None]:
            text = source[last : mark.start() if mark else None]
            for word in words_of(text):
                self.edge(word)
                if not depth:
                    self.runs[-1].append(word)
            if mark is None:
                break
            last, what = mark.end(), mark[1]
            if not depth or what == "beginOptional":
                self.runs.append([])
            if what == "beginOptional":
                depth += 1
                opened.append(self.fork())
            elif what == "endOptional":
                depth -= 1
                end = self.fork()
                self.free[opened.pop()].append(end)
            elif what.startswith("var"):
                least, most = map(int, what[4:].split("-"))
                for _ in range(least):
                    self.edge(None)
                starts = []
                for _ in range(most - least):
                    starts.append(len(self.edges) - 1)
                    self.edge(None)
                end = self.fork()
                for s in starts:
                    self.free[s].append(end)
            else:
                start, ends = self.fork(), []
                for choice in what[4:].split("|"):
                    self.state()
                    self.free[start].append(len(self.edges) - 1)
                    for word in words_of(choice):
                        self.edge(word)
                    ends.append(len(self.edges) - 1)
                end = self.state()
                for s in ends:
                    self.free[s].append(end)
        self.final = len(self.edges) - 1
        self.closed = [self.closure(s) for s in range(len(self.edges))]
        self.begins = {w for s in self.closed[0] for w, _ in self.edges[s]}
        self.anchor = b" " + b" ".join(max(self.runs, key=len)) + b" "

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def fork(self) -> int:
        """A new state that the last one moves to freely."""
        before = len(self.edges) - 1
        self.free[before].append(self.state())
        return len(self.edges) - 1

    def edge(self, word: bytes | None) -> None:
        before = len(self.edges) - 1
        self.edges[before].append((word, self.state()))

    def closure(self, state: int) -> list[int]:
        found, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return sorted(found)

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Leftmost, longest, not overlapping runs of words that the template accepts."""
        found, at = [], 0
        while at < len(words):
            end = self.accepts(words, at) if None in self.begins or words[at] in self.begins else -1
            if end > at:
                found.append((at, end))
                at = end
            else:
                at += 1
        return found

    def accepts(self, words: list[bytes], start: int) -> int:
        active, end, at = set(self.closed[0]), -1, start
        while active:
            if self.final in active:
                end = at
            if at == len(words):
                break
            word = words[at]
            active = {
                t for s in active for w, n in self.edges[s] if w is None or w == word for t in self.closed[n]
            }
            at += 1
        return end


@cache
def compiled() -> tuple[Template, ...]:
    return tuple(Template(label, source) for label, source in TEMPLATES)


def scan(text: str | None, templates: tuple[Template, ...]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in PHRASES:
        wanted = b" " + phrase.encode() + b" "
        at = joined.find(wanted)
        while at >= 0:
            starts.append(joined.count(b" ", 0, at))
            base.add(label)
            at = joined.find(wanted, at + 1)
    labels, covered = set(base), set()
    for template in templates:
        if template.anchor in joined:
            for start, end in template.matches(words):
                labels.add(template.label)
                covered.update(range(start, end))
    score = len(covered) / len(words) if words else 0.0
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base columns count the places of the fixed phrases; ``labels`` adds those of templates whose mandatory wording
    stands in the text without a gap, and ``score`` is the share of words inside such templates. Null and empty texts
    have no words, no labels and score 0; texts are read whole; null and repeated ids are carried along. An empty
    table gives an empty result.
    """
    templates = compiled()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = list(zip(*(scan(t, templates) for t in part.column("text").to_pylist())))
                arrays = [pa.array(v, k) for v, k in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *names])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
