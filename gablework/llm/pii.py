"""Personal data: fixed patterns, and more spans from a linear-chain CRF over word shapes.

The CRF is trained by gradient ascent on a small labelled table. Its labels are "none" and the four kinds. Words
without a digit or an at sign are always "none", which splits a text exactly into short chains of the other words;
the chains of a batch are padded and decoded together by Viterbi. A span of the CRF is added where it touches no
span of a pattern.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pii_labels import SENTENCES

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
#: Chains decoded at once, as words times chains after padding.
PADDED = 200_000
#: Score by which the best labels of a chain must beat "none" throughout.
MARGIN = 2.0
NEVER = 1e6

# ---- patterns: equal to the plain ones, but without their quadratic time on long runs

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin only where no digit is before, as it would have begun there.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, number of the kind, end


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, 0, done
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start, then kind."""
    if not _SIGN.search(text):
        return []
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- features of words

_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'<>()[]{}"
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-Z]{16,}")
Word = tuple[int, int, str]  # start, end, text


def shape(word: str) -> str:
    """Runs of digits as their length, of letters as x, other characters as they are."""
    word = re.sub(r"[^\W\d_]+", "x", word[:80])
    return re.sub(r"[0-9]+", lambda m: "d" + str(min(len(m[0]), 5)), word)


def features(words: list[Word], i: int) -> list[str]:
    text = words[i][2]
    core = text.strip(_EDGE)
    digits = sum(c.isdigit() for c in core)
    before = words[i - 1][2] if i else "^"
    after = words[i + 1][2] if i + 1 < len(words) else "$"
    own = [
        "shape " + shape(core),
        "digits " + str(min(digits, 20)),
        "dots " + str(min(core.count("."), 4)),
        "hyphens " + str(min(core.count("-"), 4)),
        "begins " + (core[:1] if core[:1] in "+@#=" else "."),
        "bare" if core.isdigit() else "mixed",
    ]
    figures = core.replace("-", "")
    if figures.isascii() and figures.isdigit() and 12 <= len(figures) <= 19:
        own.append("check digit " + ("right" if luhn(figures) else "wrong"))
    if "@" in core:
        own.append("at " + ("within" if 0 < core.find("@") < len(core) - 1 else "edge"))
    if "=" in core or "/" in core or "%" in core or _HEX.search(core):
        own.append("code")
    if "@" not in core and any(c.isalpha() for c in core):
        own.append("letters")
    for name, word in (("before", before), ("after", after)):
        own.append(name + " " + (shape(word.strip(_EDGE)) if _SIGN.search(word) else word.strip(_EDGE).lower()[:12]))
    return own


def chains(text: str) -> Iterator[list[tuple[Word, list[str]]]]:
    """Maximal runs of words with a digit or an at sign, with the features of each word; linear in the text."""
    done = -1
    for sign in _SIGN.finditer(text):
        if sign.start() < done:
            continue
        start = sign.start()
        while start > max(done, 0) and not text[start - 1].isspace():
            start -= 1
        run, at = [], start
        while True:
            word = _WORD.match(text, at)
            if not word or not _SIGN.search(word[0]):
                break
            run.append((word.start(), word.end(), word[0]))
            at = word.end()
            while at < len(text) and text[at].isspace():
                at += 1
        done = run[-1][1]
        head = text[max(0, start - 100) : start].split()
        tail = _WORD.match(text, at)
        around = [(0, 0, head[-1] if head else "^"), *run, (0, 0, tail[0][:100] if tail else "$")]
        yield [(word, features(around, i + 1)) for i, word in enumerate(run)]


# ---- the model

class Crf:
    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps

    def emission(self, found: list[str]) -> np.ndarray:
        """Scores of the labels; a kind that the characters of the word rule out is never chosen."""
        rows = [self.index[f] for f in found if f in self.index]
        scores = self.weights[rows].sum(axis=0) if rows else np.zeros(len(LABELS))
        if "letters" in found:
            scores[LABELS.index("ip") :] -= NEVER
        if not any(f.startswith("at ") for f in found):
            scores[LABELS.index("email")] -= NEVER
        return scores

    def decode(self, found: list[list[list[str]]]) -> list[list[int]]:
        """Best labels of each chain (a list of feature lists), all "none" where that is nearly as good."""
        n, length = len(found), max(map(len, found))
        scores = np.zeros((n, length, len(LABELS)))
        for c, chain in enumerate(found):
            for t, word in enumerate(chain):
                scores[c, t] = self.emission(word)
        sizes = np.array([len(c) for c in found])
        best = scores[:, 0] + self.steps[0]
        back = np.zeros((n, length, len(LABELS)), dtype=np.int64)
        for t in range(1, length):
            through = best[:, :, None] + self.steps[None]
            back[:, t] = through.argmax(axis=1)
            ahead = through.max(axis=1) + scores[:, t]
            best = np.where((t < sizes)[:, None], ahead, best)
        plain = scores[:, :, 0].sum(axis=1) + self.steps[0, 0] * sizes
        last = (best + self.steps[:, 0]).argmax(axis=1)
        total = (best + self.steps[:, 0]).max(axis=1)
        labels = []
        for c in range(n):
            path = [int(last[c])]
            for t in range(sizes[c] - 1, 0, -1):
                path.append(int(back[c, t, path[-1]]))
            sure = total[c] >= plain[c] + self.steps[0, 0] + MARGIN
            labels.append(path[::-1] if sure else [0] * int(sizes[c]))
        return labels


def labelled_chains() -> Iterator[tuple[list[list[str]], list[int]]]:
    for sentence in SENTENCES:
        spans, text, at = [], "", 0
        for m in re.finditer(r"\[(\w+)\|([^\]]*)\]", sentence):
            text += sentence[at : m.start()]
            spans.append((len(text), LABELS.index(m[1]), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        text += sentence[at:]
        for chain in chains(text):
            yield [f for _, f in chain], [
                next((k for s, k, e in spans if s < word[1] and word[0] < e), 0) for word, _ in chain
            ]


@cache
def trained(rounds: int = 400, rate: float = 0.1, decay: float = 0.02) -> Crf:
    """Weights by gradient ascent (Adam) on the log-likelihood of the labelled chains, less ``decay`` times a norm."""
    examples = list(labelled_chains())
    index = {f: i for i, f in enumerate(sorted({f for chain, _ in examples for word in chain for f in word}))}
    n, length, k = len(examples), max(len(c) for c, _ in examples), len(LABELS)
    held = np.zeros((n, length, len(index)))
    truth = np.zeros((n, length), dtype=np.int64)
    inside = np.zeros((n, length), dtype=bool)
    for c, (chain, labels) in enumerate(examples):
        for t, word in enumerate(chain):
            held[c, t, [index[f] for f in word]] = 1
            truth[c, t], inside[c, t] = labels[t], True
    sizes = inside.sum(axis=1)
    once = np.eye(k)[truth] * inside[:, :, None]
    # Chains begin after and end before "none", as the words around them are.
    seen_steps = np.zeros((k, k))
    for c in range(n):
        path = [0, *truth[c, : sizes[c]].tolist(), 0]
        np.add.at(seen_steps, (path[:-1], path[1:]), 1)
    seen = np.einsum("ctf,ctk->fk", held, once)
    weights, steps = np.zeros((len(index), k)), np.zeros((k, k))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, steps)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        scores = held @ weights
        ahead = np.zeros((n, length, k))
        ahead[:, 0] = scores[:, 0] + steps[0]
        for t in range(1, length):
            ahead[:, t] = lse(ahead[:, t - 1][:, :, None] + steps[None], 1) + scores[:, t]
        behind = np.zeros((n, length, k))
        for t in range(length - 1, -1, -1):
            final = np.broadcast_to(steps[:, 0], (n, k))
            if t + 1 < length:
                onward = lse(steps[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                behind[:, t] = np.where((t == sizes - 1)[:, None], final, onward)
            else:
                behind[:, t] = final
        norm = lse(ahead[np.arange(n), sizes - 1] + steps[:, 0], 1)
        share = np.exp(ahead + behind - norm[:, None, None]) * inside[:, :, None]
        want_steps = np.zeros((k, k))
        want_steps[0] += share[:, 0].sum(axis=0)
        want_steps[:, 0] += share[np.arange(n), sizes - 1].sum(axis=0)
        for t in range(1, length):
            joint = ahead[:, t - 1][:, :, None] + steps[None] + (scores[:, t] + behind[:, t])[:, None, :]
            want_steps += (np.exp(joint - norm[:, None, None]) * inside[:, t][:, None, None]).sum(axis=0)
        slopes = (
            seen - np.einsum("ctf,ctk->fk", held, share) - decay * weights,
            seen_steps - want_steps - decay * steps,
        )
        for x, slope, (m, v) in zip((weights, steps), slopes, moments):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope**2 - v)
            x += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Crf(index, weights, steps)


def added_spans(texts: list[str], base: list[list[Span]], model: Crf) -> list[list[Span]]:
    """Per text the spans of the model that touch no base span; edge punctuation is left out."""
    todo = [(i, chain) for i, text in enumerate(texts) if _SIGN.search(text) for chain in chains(text)]
    todo.sort(key=lambda x: len(x[1]))
    out: list[list[Span]] = [[] for _ in texts]
    starts = [[s for s, _, _ in spans] for spans in base]
    reach = [list(accumulate((e for _, _, e in spans), max)) for spans in base]
    at = 0
    while at < len(todo):  # by length: chains of a batch need little padding
        to = at + 1
        while to < len(todo) and (to + 1 - at) * len(todo[to][1]) <= PADDED:
            to += 1
        part, at = todo[at:to], to
        for (i, chain), labels in zip(part, model.decode([[f for _, f in chain] for _, chain in part])):
            t = 0
            while t < len(labels):
                if not labels[t]:
                    t += 1
                    continue
                last = t
                while last + 1 < len(labels) and labels[last + 1] == labels[t]:
                    last += 1
                start, end = chain[t][0][0], chain[last][0][1]
                text = texts[i]
                while start < end and text[start] in ".,;:!?\"'<>[]{}":
                    start += 1
                while end > start and text[end - 1] in ".,;:!?\"'<>[]{}":
                    end -= 1
                before = bisect_left(starts[i], end)
                if start < end and not (before and reach[i][before - 1] > start):
                    out[i].append((start, labels[t] - 1, end))
                t = last + 1
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base, spans.

    ``base`` has the spans of the patterns and ``spans`` those and the ones that the model adds, as kind:start:end by
    start, then kind; code points, end exclusive. The counts are of base spans. Null texts count as empty and have
    none; texts are read whole; null and repeated ids are carried along. An empty table gives an empty result.
    """
    model = model or trained()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model)
                counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                spans = pa.array([written(sorted(b + m)) for b, m in zip(base, more)], pa.string())
                arrays = [part.column("doc_id"), *counts, pa.array(map(written, base), pa.string()), spans]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")
