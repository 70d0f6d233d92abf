"""A gated recurrent language model over words, trained and applied by Spark tasks.

The network is a gated recurrent unit over word embeddings. Its output softmax is factored by classes of words of
like frequency: P(word) = P(class) P(word | class), so a word costs two small softmaxes instead of one over the
vocabulary. Training is truncated backpropagation in numpy: gradients stop at the window's start, the state is
carried on. Scoring carries the state over all windows of a document, so that a score is the whole document's.

All training documents are used once. They are dealt over rounds and, in a round, over replicas of some tokens each;
replicas start from the same weights, and their weights are averaged by tokens after the round. Words are counted
corpus-wide; the most frequent ones are the vocabulary. Any other word has the probability of the unknown word times
its share, by add-one counts, among the words outside the vocabulary.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import stored, table

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END, UNKNOWN = 0, 1
HELD_MODULUS, HELD_REMAINDER = 7, 2
NEVER = -1e4
BLOCK_BYTES = 8 << 20
CHUNK, SUMMED_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 64, 2048


@dataclass(frozen=True)
class Shape:
    """The model's size and its training. The first class holds the end and the unknown word, all others
    ``class_words`` words each; words of fewer than ``least_count`` occurrences or more than ``longest_word`` bytes
    count as unknown. Documents of some
    ``pool_words`` words run together in at most ``most_lanes`` lanes, ``spread`` times as many as would be as long
    as the longest document."""

    classes: int = 32
    class_words: int = 64
    inner: int = 16
    embedding: int = 16
    window: int = 48
    scored_window: int = 96
    least_lanes: int = 32
    most_lanes: int = 256
    scored_lanes: int = 512
    spread: int = 1
    rate: float = 0.1
    rounds: int = 3
    replica_tokens: int = 4_000_000
    pool_words: int = 2_000_000
    least_count: int = 20
    longest_word: int = 64
    seed: int = 7

    @property
    def places(self) -> int:
        return self.classes * self.class_words

    @property
    def most_words(self) -> int:
        return self.places - self.class_words

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, d = self.inner, self.embedding
        return {
            "embed": (self.places, d),
            "in_w": (d, 3 * h),
            "in_b": (3 * h,),
            "state_w": (h, 3 * h),
            "class_w": (h, self.classes),
            "class_b": (self.classes,),
            "word_w": (self.classes, h, self.class_words),
            "word_b": (self.classes, self.class_words),
        }


def views(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of a flat vector, without copying."""
    out, at = {}, 0
    for name, size in shape.parts().items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def first_weights(shape: Shape, counts: np.ndarray) -> np.ndarray:
    """Small random weights; the output biases alone give the counts' shares. Places without a word have none."""
    draw = np.random.default_rng(shape.seed)
    flat = np.zeros(sum(int(np.prod(s)) for s in shape.parts().values()), dtype=np.float32)
    w = views(shape, flat)
    for name, spread in (("embed", 0.3), ("in_w", shape.embedding**-0.5), ("state_w", shape.inner**-0.5)):
        w[name][:] = draw.normal(size=w[name].shape) * spread
    with np.errstate(divide="ignore"):
        share = np.where(counts >= 0, counts + 1.0, 0.0).reshape(shape.classes, shape.class_words)
        whole = share.sum(1, keepdims=True)
        w["word_b"][:] = np.maximum(np.log(share / np.maximum(whole, 1.0)), NEVER)
        w["class_b"][:] = np.maximum(np.log(whole[:, 0] / whole.sum()), NEVER)
    return flat


@dataclass
class Lanes:
    """Documents laid end to end in lanes, steps by lanes; longer lanes come first, -1 ends a lane."""

    inputs: np.ndarray
    targets: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    active: np.ndarray  # lanes per step


def lanes_of(shape: Shape, ids: np.ndarray, lengths: np.ndarray, most: int) -> Lanes:
    """``ids`` holds the words of documents of the given lengths; each gets its end, and starts from an end's state."""
    sizes = lengths + 1
    total, longest = int(sizes.sum()), int(sizes.max())
    count = min(len(sizes), max(shape.least_lanes, min(most, shape.spread * total // longest)))
    heap = [(0, k) for k in range(count)]
    held: list[list[int]] = [[] for _ in range(count)]
    for doc in np.argsort(-sizes, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        held[k].append(doc)
        heapq.heappush(heap, (load + int(sizes[doc]), k))
    loads = np.array([sizes[x].sum() for x in held])
    order = np.argsort(-loads, kind="stable")
    steps, begin = int(loads.max()), np.cumsum(lengths) - lengths
    inputs = np.zeros((steps, count), dtype=np.int32)
    targets = np.full((steps, count), -1, dtype=np.int32)
    starts = np.zeros((steps, count), dtype=bool)
    owner = np.full((steps, count), -1, dtype=np.int32)
    for lane, k in enumerate(order.tolist()):
        at = 0
        for doc in held[k]:
            n = int(lengths[doc])
            words = ids[begin[doc] : begin[doc] + n]
            inputs[at, lane], starts[at, lane] = END, True
            inputs[at + 1 : at + n + 1, lane] = words
            targets[at : at + n, lane] = words
            targets[at + n, lane] = END
            owner[at : at + n + 1, lane] = doc
            at += n + 1
    return Lanes(inputs, targets, starts, owner, (targets >= 0).sum(1))


class Network:
    """The network over flat weights. ``run`` gives a window's log-probabilities, ``learn`` also its gradients."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.w = shape, views(shape, flat)
        widths = (self.w["word_b"] > NEVER).sum(1)  # the words of a class come first, then its free places
        self.widths = np.maximum(widths, 1).tolist()

    def forward(self, inputs: np.ndarray, starts: np.ndarray, state: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
        """The states after every step; with ``keep``, also what their gradients need."""
        w, h = self.w, self.shape.inner
        steps, lanes = inputs.shape
        embedded = w["embed"][inputs.reshape(-1)]
        x = (embedded @ w["in_w"] + w["in_b"]).reshape(steps, lanes, 3 * h)
        go_on = (~starts).astype(np.float32)[:, :, None]
        states = np.empty((steps, lanes, h), dtype=np.float32)
        held = {n: np.empty((steps, lanes, k), dtype=np.float32) for n, k in (("before", h), ("gates", 2 * h), ("new", h), ("inner", h))} if keep else {}
        for t in range(steps):
            before = state * go_on[t]
            g = before @ w["state_w"]
            gates = g[:, : 2 * h]
            gates += x[t, :, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1.0
            gates *= 0.5
            inner = g[:, 2 * h :]
            new = gates[:, h:] * inner
            new += x[t, :, 2 * h :]
            np.tanh(new, out=new)
            state = states[t]
            np.subtract(before, new, out=state)
            state *= gates[:, :h]
            state += new
            if keep:
                held["before"][t], held["gates"][t], held["new"][t], held["inner"][t] = before, gates, new, inner
        if keep:
            held |= {"embedded": embedded, "go_on": go_on}
        return states, held

    @staticmethod
    def softmax(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, chosen: np.ndarray, shift: bool = False) -> tuple:
        """Log-probabilities of the chosen columns, and the exponentials of the logits with their row sums.

        Without ``shift`` logits far from 0 may leave the range of the numbers; what is then returned is not finite.
        """
        logits = states @ weights
        logits += bias
        if shift:
            logits -= logits.max(1, keepdims=True)
        picked = logits[np.arange(len(logits)), chosen]
        np.exp(logits, out=logits)
        whole = logits @ np.ones(logits.shape[1], dtype=np.float32)
        picked -= np.log(whole)
        return picked, logits, whole

    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target; with ``grads``, their gradients are set and those of the states given."""
        order = np.argsort(targets, kind="stable")  # so that a class is one slice
        with np.errstate(all="ignore"):
            found, back = self.sorted_output(states[order], targets[order], grads, False)
        if not np.isfinite(found).all():
            found, back = self.sorted_output(states[order], targets[order], grads, True)
        logp = np.empty_like(found)
        logp[order] = found
        if grads is None:
            return logp, None
        placed = np.empty_like(back)
        placed[order] = back
        return logp, placed

    def sorted_output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None, shift: bool) -> tuple[np.ndarray, np.ndarray | None]:
        w, s = self.w, self.shape
        kind, word = targets // s.class_words, targets % s.class_words
        found = np.empty(len(targets), dtype=np.float32)
        back = None if grads is None else np.empty_like(states)
        if grads is not None:
            grads["class_w"][:], grads["class_b"][:], grads["word_w"][:], grads["word_b"][:] = 0.0, 0.0, 0.0, 0.0

        def one(part, weights, bias, chosen, grad_w, grad_b):
            """One softmax over some rows, whose gradients are added to; returns log-probabilities and the states' gradients."""
            inside, z, whole = self.softmax(part, weights, bias, chosen, shift)
            if grad_w is None:
                return inside, None
            z *= (1.0 / whole)[:, None]
            z[np.arange(len(z)), chosen] -= 1.0
            grad_w += part.T @ z
            grad_b += np.ones(len(z), dtype=np.float32) @ z
            return inside, z @ weights.T

        parts = (None, None) if grads is None else (grads["class_w"], grads["class_b"])
        for at in range(0, len(targets), ROWS_AT_ONCE):
            rows = slice(at, at + ROWS_AT_ONCE)
            found[rows], d = one(states[rows], w["class_w"], w["class_b"], kind[rows], *parts)
            if grads is not None:
                back[rows] = d
        first = 0
        for c, last in enumerate(np.cumsum(np.bincount(kind, minlength=s.classes)).tolist()):
            if last > first:
                n = self.widths[c]
                parts = (None, None) if grads is None else (grads["word_w"][c, :, :n], grads["word_b"][c, :n])
                inside, d = one(states[first:last], w["word_w"][c, :, :n], w["word_b"][c, :n], word[first:last], *parts)
                found[first:last] += inside
                if grads is not None:
                    back[first:last] += d
                first = last
        return found, back

    def backward(self, held: dict, inputs: np.ndarray, d_states: np.ndarray, grads: dict) -> None:
        """Gradients of the recurrent part; none go back beyond the window's first step."""
        w, h = self.w, self.shape.inner
        steps, lanes = inputs.shape
        d_x = np.empty((steps, lanes, 3 * h), dtype=np.float32)
        d_g = np.empty((steps, lanes, 3 * h), dtype=np.float32)
        after = np.zeros((lanes, h), dtype=np.float32)
        back_w = np.ascontiguousarray(w["state_w"].T)
        for t in reversed(range(steps)):
            before, gates, new, inner = (held[n][t] for n in ("before", "gates", "new", "inner"))
            update, reset = gates[:, :h], gates[:, h:]
            d = d_states[t] + after
            rest = d * (1.0 - update)
            d_new = d_x[t, :, 2 * h :]
            np.multiply(rest, 1.0 - new * new, out=d_new)
            rest *= update
            np.multiply(rest, before - new, out=d_x[t, :, :h])
            back = d_new * reset
            np.multiply(back * inner, 1.0 - reset, out=d_x[t, :, h : 2 * h])
            d_g[t, :, : 2 * h] = d_x[t, :, : 2 * h]
            d_g[t, :, 2 * h :] = back
            d *= update
            d += d_g[t] @ back_w
            d *= held["go_on"][t]
            after = d
        flat_x = d_x.reshape(-1, 3 * h)
        grads["state_w"] += held["before"].reshape(-1, h).T @ d_g.reshape(-1, 3 * h)
        grads["in_w"] += held["embedded"].T @ flat_x
        grads["in_b"] += flat_x.sum(0)
        d_embedded = flat_x @ w["in_w"].T
        used = inputs.reshape(-1)
        order = np.argsort(used, kind="stable")
        ids, first = np.unique(used[order], return_index=True)
        grads["embed"][ids] += np.add.reduceat(d_embedded[order], first, axis=0)

    @staticmethod
    def windows(lanes: Lanes, steps: int) -> Iterator[tuple[slice, int]]:
        for start in range(0, len(lanes.active), steps):
            yield slice(start, start + steps), int(lanes.active[start])

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log-probability of each document, its end included."""
        lanes = lanes_of(self.shape, ids, lengths, self.shape.scored_lanes)
        sums = np.zeros(len(lengths))
        state = np.zeros((lanes.targets.shape[1], self.shape.inner), dtype=np.float32)
        for at, width in self.windows(lanes, self.shape.scored_window):
            states, _ = self.forward(lanes.inputs[at, :width], lanes.starts[at, :width], state[:width], False)
            state = states[-1]
            targets = lanes.targets[at, :width].reshape(-1)
            real = np.flatnonzero(targets >= 0)
            logp, _ = self.output(states.reshape(-1, self.shape.inner)[real], targets[real])
            sums += np.bincount(lanes.owner[at, :width].reshape(-1)[real], weights=logp, minlength=len(sums))
        return sums


class Trainer:
    """Adagrad on the gradients of one window after the other; ``flat`` are the weights, ``squares`` their step sizes."""

    def __init__(self, shape: Shape, flat: np.ndarray, squares: np.ndarray):
        self.shape, self.flat, self.squares = shape, flat.copy(), squares.copy()
        self.network = Network(shape, self.flat)
        self.grad = np.zeros_like(self.flat)
        self.grads = views(shape, self.grad)

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> float:
        """One pass over the documents; the sum of log-probabilities met on the way."""
        lanes, net, total = lanes_of(self.shape, ids, lengths, self.shape.most_lanes), self.network, 0.0
        state = np.zeros((lanes.targets.shape[1], self.shape.inner), dtype=np.float32)
        for at, width in net.windows(lanes, self.shape.window):
            inputs = lanes.inputs[at, :width]
            states, held = net.forward(inputs, lanes.starts[at, :width], state[:width], True)
            state = states[-1]
            targets = lanes.targets[at, :width].reshape(-1)
            real = np.flatnonzero(targets >= 0)
            self.grad[:] = 0.0
            logp, back = net.output(states.reshape(-1, self.shape.inner)[real], targets[real], self.grads)
            d_states = np.zeros((states.shape[0] * width, self.shape.inner), dtype=np.float32)
            d_states[real] = back
            net.backward(held, inputs, d_states.reshape(states.shape), self.grads)
            self.step(self.shape.window * lanes.targets.shape[1])
            total += float(logp.sum())
        return total

    def step(self, places: int) -> None:
        """``places`` are those of a full window: the last ones, where few lanes go on, count by their tokens."""
        self.grad /= places
        self.squares += self.grad * self.grad
        self.grad /= np.sqrt(self.squares)
        self.grad *= self.shape.rate
        self.flat -= self.grad


COUNTED = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("doc_words", pa.list_(pa.int32())),
        ("word", pa.binary()),
        ("words", pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))),
    ]
)
COUNTED_DDL = "block long, doc_id array<long>, held_out array<boolean>, doc_words array<int>, word binary, words array<struct<key: binary, n: long>>"
READY = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("doc_words", pa.list_(pa.int32())),
        ("ids", pa.binary()),
        ("n_words", pa.int64()),
        ("learned", pa.int64()),
        ("n_known", pa.list_(pa.int64())),
        ("base_score", pa.list_(pa.float64())),
        ("doc_rare", pa.list_(pa.int32())),
        ("rare", pa.binary()),
        ("rare_words", pa.list_(pa.binary())),
    ]
)
READY_DDL = (
    "block long, doc_id array<long>, held_out array<boolean>, doc_words array<int>, ids binary, n_words long, learned long, "
    "n_known array<long>, base_score array<double>, doc_rare array<int>, rare binary, rare_words array<binary>"
)
BASE = pa.schema([("block", pa.int64()), *[(n, pa.list_(k)) for n, k in (("n_known", pa.int64()), ("base_score", pa.float64()), ("outside", pa.float64()))]])
BASE_DDL = "block long, n_known array<long>, base_score array<double>, outside array<double>"
MODEL = pa.schema([("block", pa.int64()), *[(n, pa.list_(k)) for n, k in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("logp", pa.float64()))]])
MODEL_DDL = "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, logp array<double>"


def count_block(rows: pa.RecordBatch) -> dict:
    """A block's words, each once, with their number in its training documents."""
    number: dict[bytes, int] = {}
    owned = []
    for text in rows.column("text").cast(pa.binary()).to_pylist():
        owned.append([number.setdefault(w, len(number)) for w in text.translate(LOWER).split()])
    lengths = np.array([len(x) for x in owned], dtype=np.int64)
    word = np.fromiter(chain.from_iterable(owned), dtype=np.int32, count=int(lengths.sum()))
    held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    counts = np.bincount(word[np.repeat(~held, lengths)], minlength=len(number)).astype(np.int64)
    return {
        "doc_id": rows.column("doc_id").to_pylist(),
        "held_out": held,
        "doc_words": lengths.astype(np.int32),
        "word": B.binary(word),
        "words": pa.StructArray.from_arrays([pa.array(list(number), pa.binary()), pa.array(counts)], ["key", "n"]),
    }


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each document's values; 0 for none."""
    out = np.zeros(len(lengths), dtype=values.dtype)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return out


@dataclass
class Corpus:
    """Counts over the training documents: tokens and different ones, ends included; ``vocabulary`` in order of count."""

    tokens: int
    distinct: int
    ends: int
    vocabulary: list[tuple[bytes, int]]

    @property
    def whole(self) -> float:
        """The logarithm that the base subtracts from that of every count."""
        return float(np.log10(float(self.tokens + self.distinct + 1)))

    @property
    def outside(self) -> tuple[int, int]:
        """Tokens and different ones outside the vocabulary."""
        known = self.ends + sum(n for _, n in self.vocabulary)
        return self.tokens - known, self.distinct - len(self.vocabulary) - (self.ends > 0)

    def place_counts(self, shape: Shape) -> np.ndarray:
        """Per place its count; -1 where no word is."""
        out = np.full(shape.places, -1.0)
        out[END], out[UNKNOWN] = self.ends, sum(self.outside)  # with one more for each, the base's own shares
        out[shape.class_words : shape.class_words + len(self.vocabulary)] = [n for _, n in self.vocabulary]
        return out


def ready_block(row: dict, corpus: Corpus, place: dict[bytes, int], shape: Shape) -> dict:
    """A block as the network reads it, with the base of the vocabulary's words and the places of all others."""
    words = row["words"].values.field("key").to_pylist()
    word = np.frombuffer(row["word"].as_buffer(), dtype=np.int32)
    lengths = row["doc_words"].values.to_numpy(zero_copy_only=False).astype(np.int64)
    held = row["held_out"].values.to_numpy(zero_copy_only=False).astype(bool)
    ids = np.array([place.get(w, UNKNOWN) for w in words], dtype=np.uint16)
    counts = np.maximum(corpus.place_counts(shape), 0.0)
    known = ids != UNKNOWN
    base = np.where(known, np.log10(counts[ids] + 1.0) - corpus.whole, 0.0)
    rare = np.flatnonzero(~known)
    number = np.zeros(len(words), dtype=np.int32)
    number[rare] = np.arange(len(rare))
    is_rare = ~known[word]
    return {
        "block": row["block"].as_py(),
        "doc_id": row["doc_id"].as_py(),
        "held_out": held,
        "doc_words": lengths.astype(np.int32),
        "ids": B.compressed(ids[word]),
        "n_words": len(word),
        "learned": int((lengths + 1)[~held].sum()),
        "n_known": sums(known.astype(np.int64)[word], lengths) + (corpus.ends > 0),
        "base_score": sums(base[word], lengths) + np.log10(corpus.ends + 1.0) - corpus.whole,
        "doc_rare": sums(is_rare.astype(np.int32), lengths),
        "rare": B.compressed(number[word[is_rare]]),
        "rare_words": [words[k] for k in rare.tolist()],
    }


def base_block(row: dict, corpus: Corpus) -> dict:
    """The base with the words outside the vocabulary, and their share of the unknown word's probability."""
    counts = B.answers(row, "n", np.int64)
    rare = B.numbers(row["rare"], np.int32)
    lengths = row["doc_rare"].values.to_numpy(zero_copy_only=False).astype(np.int64)
    grown = np.log10(counts + 1.0)
    share = np.log10(float(sum(corpus.outside) + 1))
    return {
        "block": row["block"].as_py(),
        "n_known": row["n_known"].values.to_numpy() + sums((counts > 0).astype(np.int64)[rare], lengths),
        "base_score": row["base_score"].values.to_numpy() + sums((grown - corpus.whole)[rare], lengths),
        "outside": sums((grown - share)[rare], lengths),
    }


@dataclass
class Documents:
    """Blocks set end to end: the words of all their documents and the numbers of those, with the blocks' rows."""

    rows: list[dict]
    ids: np.ndarray
    lengths: np.ndarray
    held_out: np.ndarray

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and their numbers of those that are not held out."""
        return self.ids[np.repeat(~self.held_out, self.lengths)], self.lengths[~self.held_out]


def pools(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[Documents]:
    """Blocks joined until they have so many words."""

    def pooled(held: list[dict]) -> Documents:
        lists = [pa.concat_arrays([r[n].values for r in held]).to_numpy(zero_copy_only=False) for n in ("doc_words", "held_out")]
        return Documents(held, np.concatenate([B.numbers(r["ids"], np.uint16) for r in held]), lists[0].astype(np.int64), lists[1].astype(bool))

    held: list[dict] = []
    words = 0
    for row in B.rows(batches):
        held.append(row)
        words += row["n_words"].as_py()
        if words >= most_words:
            yield pooled(held)
            held, words = [], 0
    if held:
        yield pooled(held)


WEIGHTS_DDL = "part long, chunk int, tokens long, weights binary"


def averaged(rows: DataFrame, parts: int) -> np.ndarray:
    """The mean of replicas' weights by tokens, chunk by chunk, at most 64 replicas at once and then their means."""

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        tokens = group.column("tokens").to_numpy()
        total = sum(
            np.frombuffer(w.as_buffer(), dtype=np.float32).astype(np.float64) * n for w, n in zip(group.column("weights"), tokens.tolist())
        )
        whole = int(tokens.sum())
        out = {"part": [group.column("part")[0].as_py() // SUMMED_AT_ONCE], "chunk": [group.column("chunk")[0].as_py()], "tokens": [whole]}
        out["weights"] = [B.binary((total / max(whole, 1)).astype(np.float32))]
        return pa.table(out, pa.schema([("part", pa.int64()), ("chunk", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())]))

    while True:
        rows = rows.groupBy("chunk", F.expr(f"part div {SUMMED_AT_ONCE}").alias("_lot")).applyInArrow(lambda _, t: mean(t.select(["part", "chunk", "tokens", "weights"])), WEIGHTS_DDL)
        parts = -(-parts // SUMMED_AT_ONCE)
        if parts == 1:
            break
    return np.concatenate([np.frombuffer(r.weights, dtype=np.float32) for r in rows.orderBy("chunk").collect()])


def trained(ready: DataFrame, corpus: Corpus, shape: Shape) -> np.ndarray:
    """The weights after all rounds. The driver holds one set of weights, of a size that the shape gives."""
    flat = first_weights(shape, corpus.place_counts(shape))
    squares = np.full_like(flat, 1e-8)
    facts = ready.agg(F.sum("learned").alias("tokens"), F.count("*").alias("blocks"), F.max(F.shiftright("block", 32)).alias("last")).first()
    if not facts.tokens:
        return flat
    rounds = min(shape.rounds, facts.blocks)
    replicas = max(1, -(-facts.tokens // (rounds * shape.replica_tokens)))
    step = -(-facts.blocks // (facts.last + 1))
    slot = F.pmod(F.shiftright("block", 32) * step + F.col("block").bitwiseAND(2**32 - 1), F.lit(rounds * replicas))
    dealt = ready.where("learned > 0").select("block", "held_out", "doc_words", "ids", "n_words", slot.alias("slot"))
    for k in range(rounds):
        start, start_squares = flat, squares

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, tokens, part = Trainer(shape, start, start_squares), 0, TaskContext.get().partitionId()
            for pool in pools(batches, shape.pool_words):
                ids, lengths = pool.learned()
                trainer.learn(ids, lengths)
                tokens += len(ids) + len(lengths)
            if tokens:
                both = np.concatenate([trainer.flat, trainer.squares])
                pieces = [B.binary(both[at : at + CHUNK]) for at in range(0, len(both), CHUNK)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([tokens] * n, pa.int64()), pa.array(pieces, pa.binary())],
                    names=["part", "chunk", "tokens", "weights"],
                )

        own = dealt.where(F.col("slot") % rounds == k).withColumn("replica", F.expr(f"cast(slot div {rounds} as int)"))
        placed = own.repartitionById(replicas, "replica").sortWithinPartitions("block").drop("slot", "replica")
        both = averaged(stored(placed.mapInArrow(learn, WEIGHTS_DDL)), replicas)
        if len(both):
            flat, squares = both[: len(flat)], both[len(flat) :]
    return flat


@dataclass
class Scored:
    """``documents``: a row per document; ``weights`` and ``corpus``: the model, which ``network`` makes ready."""

    documents: DataFrame
    corpus: Corpus
    shape: Shape
    weights: np.ndarray

    def network(self) -> Network:
        return Network(self.shape, self.weights)


def language_model(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None, block_bytes: int = BLOCK_BYTES
) -> Scored:
    """Counts, trains and scores; rows marked ``held_out`` (null: not) are scored only.

    Every input row gives one: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text is
    empty and has the end alone. Null and repeated ids are carried along, each row being a document of its own.
    Without training documents all counts are 0, and so is ``base_score``. An empty table gives an empty result.
    """
    shape = shape or Shape()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, rows in enumerate(B.slices(batches, block_bytes)):
            yield B.one_row(COUNTED, count_block(rows) | {"block": B.block_number(i)})

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = stored(texts.mapInArrow(count, COUNTED_DDL), "zstd")
    counts = stored(rows.select(F.inline("words")).where(F.col("n") > 0).groupBy("key").agg(F.sum("n").alias("n")))
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    ends = rows.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.lit(0))).first()[0]
    fit = counts.where((F.octet_length("key") <= shape.longest_word) & (F.col("n") >= shape.least_count))
    most = fit.orderBy(F.desc("n"), "key").limit(shape.most_words).collect()
    corpus = Corpus(facts.tokens + ends, facts.distinct + (ends > 0), ends, [(bytes(r.key), r.n) for r in most])
    place = {w: i for i, (w, _) in enumerate(corpus.vocabulary, shape.class_words)}

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            yield B.one_row(READY, ready_block(row, corpus, place, shape))

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            yield B.one_row(BASE, base_block(row, corpus))

    ready = stored(rows.mapInArrow(prepare, READY_DDL), "zstd")
    rare = B.looked_up(ready.select("block", "n_known", "base_score", "doc_rare", "rare", "rare_words"), "rare_words", counts, ["n"])
    weights = trained(ready, corpus, shape)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shape, weights)
        for pool in pools(batches, shape.pool_words):
            logp, at = network.score(pool.ids, pool.lengths) / np.log(10.0), 0
            for row in pool.rows:
                n = len(row["doc_words"])
                values = {"doc_id": row["doc_id"].as_py(), "held_out": row["held_out"].as_py(), "block": row["block"].as_py()}
                yield B.one_row(MODEL, values | {"n_tokens": pool.lengths[at : at + n] + 1, "logp": logp[at : at + n]})
                at += n

    modelled = ready.select("block", "doc_id", "held_out", "doc_words", "ids", "n_words").mapInArrow(score, MODEL_DDL)
    both = modelled.join(rare.mapInArrow(base, BASE_DDL), "block")
    each = both.select(F.inline(F.arrays_zip("doc_id", "held_out", "n_tokens", "n_known", "base_score", "logp", "outside")))
    documents = each.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("logp") + F.col("outside")).alias("score")
    )
    return Scored(documents, corpus, shape, weights)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return language_model(table(spark, sf_dir, "documents"), F.pmod(crc, F.lit(HELD_MODULUS)) == HELD_REMAINDER).documents
