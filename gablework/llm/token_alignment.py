"""Alignment of two tokenizers' tokens over a corpus, with a fast path for tokens of the same bytes.

Both tokenizers cover the same bytes. Offsets where a token of each ends cut the text into groups. Most groups hold
one token of each side, with the same bytes; which B id that is for an A id is a fixed array, so such groups are
counted in one vector of the vocabulary's length per task. Only the pairs of the other, irregular groups are counted
by a shuffle, after they have been summed per block of documents.

Neither tokenizer joins characters across the start of a run of blanks, tabs and line ends (checked on B's vocabulary,
and given by A's pattern), so every block encodes each distinct run of blanks with its word once, in batches. Texts
with other white space are encoded as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import stored, table
from .packing import public_tokenizer

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BATCH = 4096
#: White space that may end a chunk, if B's vocabulary allows; texts with any other are one chunk.
SEPARATORS = " \n\t"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Groups:
    """Groups and links of texts set end to end; ``link_*`` are parallel arrays in the order of A's tokens."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray  # place of the A token
    link_b: np.ndarray


def groups_of(len_a: np.ndarray, len_b: np.ndarray) -> Groups:
    """Groups between common ends, and all pairs of tokens whose byte ranges overlap."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    first = np.searchsorted(end_b, end_a - len_a, "right")
    count = np.searchsorted(end_b - len_b, end_a, "left") - first
    link_a = np.repeat(np.arange(len(end_a)), count)
    place = np.arange(len(link_a)) - np.repeat(np.cumsum(count) - count, count)
    return Groups(np.searchsorted(common, end_a), np.searchsorted(common, end_b), link_a, np.repeat(first, count) + place)


class Pair:
    """The two tokenizers with their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = byte_values()
        size = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in zip(pieces, single)
        ]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        special = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(pieces))]
        # Where bytes have two ids, the one that is no single-byte fallback, then the lower one.
        by_bytes = {x: i for x, i in sorted(zip(self.bytes_b, range(len(pieces))), key=lambda p: (not single[p[1]], -p[1])) if not special[i]}
        self.same = np.array([by_bytes.get(x, -1) for x in self.bytes_a])
        self.blank = self.b.piece_to_id("▁")
        spaced = [p.replace("▁", " ") for p in pieces]
        self.separators = "".join(
            s for s in SEPARATORS if not any(s in (p.lstrip(" ") if s == " " else p) for p in spaced)
        )
        one = re.escape(self.separators)
        self.chunk = re.compile(f"[{one}]*[^{one}]+|[{one}]+") if " " in self.separators else None
        self.odd = re.compile(f"(?![{one}])[\\s\\x1c-\\x1f]")
        marks = ",|;"
        self.marked_a = [f"{i}{m}" for m in marks for i in range(size)]
        self.marked_b = [f"{i}{m}" for m in marks for i in range(len(pieces))]

    def chunks(self, text: str) -> list[str]:
        """Parts of a blank and the text that both tokenizers encode apart."""
        whole = " " + text
        if self.chunk is None or self.odd.search(whole):
            return [whole]
        return self.chunk.findall(whole)

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """B's own blank stands for a chunk's first one; before other white space it is a token alone, and dropped."""
        ids = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [
            self.blank_alone(c) if c == " " else x[1:] if c[0] != " " and x[:1] == [self.blank] else x for c, x in zip(chunks, ids)
        ]

    def blank_alone(self, chunk: str) -> list[int]:
        """A text that is no more than its blank; B returns nothing for an empty text."""
        return [self.blank]


_SHARED: dict[tuple[str, str], Pair] = {}


def shared_pair(path_a: str, path_b: str) -> Pair:
    """One per Python worker."""
    if (path_a, path_b) not in _SHARED:
        _SHARED[path_a, path_b] = Pair(path_a, path_b)
    return _SHARED[path_a, path_b]


class Chunks:
    """The distinct chunks of a block, aligned together."""

    def __init__(self, pair: Pair, chunks: list[str]):
        sides_a: list[list[int]] = []
        sides_b: list[list[int]] = []
        self.good = np.zeros(len(chunks), dtype=bool)
        bytes_a, bytes_b = pair.bytes_a.__getitem__, pair.bytes_b.__getitem__
        for at in range(0, len(chunks), BATCH):
            part = chunks[at : at + BATCH]
            for i, (c, x, y) in enumerate(zip(part, pair.encode_a(part), pair.encode_b(part)), at):
                expected = c.encode()
                self.good[i] = b"".join(map(bytes_a, x)) == expected and b"".join(map(bytes_b, y)) == expected
                sides_a.append(x if self.good[i] else [])
                sides_b.append(y if self.good[i] else [])
        self.n_a = np.array([len(x) for x in sides_a], dtype=np.int64)
        self.n_b = np.array([len(x) for x in sides_b], dtype=np.int64)
        a = np.fromiter(chain.from_iterable(sides_a), dtype=np.int64, count=int(self.n_a.sum()))
        b = np.fromiter(chain.from_iterable(sides_b), dtype=np.int64, count=int(self.n_b.sum()))
        found = groups_of(pair.len_a[a], pair.len_b[b])
        n_groups = int(found.group_a[-1]) + 1 if len(a) else 0
        size_a, size_b = np.bincount(found.group_a, minlength=n_groups), np.bincount(found.group_b, minlength=n_groups)
        chunk_a = np.repeat(np.arange(len(chunks)), self.n_a)
        first = np.cumsum(size_a) - size_a  # of each group, the place of its first A token
        self.n_groups = np.bincount(chunk_a[first], minlength=len(chunks))
        self.n_links = np.bincount(chunk_a[found.link_a], minlength=len(chunks))
        self.link_a, self.link_b = a[found.link_a], b[found.link_b]
        group = found.group_a[found.link_a]
        self.regular = (size_a[group] == 1) & (size_b[group] == 1) & (pair.same[self.link_a] == self.link_b)
        self.link_chunk = chunk_a[found.link_a]
        self.texts = self.described(pair, a, b, found, size_a, size_b)

    def described(self, pair: Pair, a, b, found: Groups, size_a, size_b) -> list[str]:
        """The groups of each chunk as ``a1,a2|b1;a3|b2`` and a closing semicolon."""
        last_a = np.r_[found.group_a[1:] != found.group_a[:-1], True][: len(a)]
        last_b = np.r_[found.group_b[1:] != found.group_b[:-1], True][: len(b)]
        before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        marked = np.empty(len(a) + len(b), dtype=np.int64)
        total = len(pair.marked_a)
        marked[np.arange(len(a)) + before_b[found.group_a]] = a + np.where(last_a, len(pair.bytes_a), 0)
        marked[np.arange(len(b)) + upto_a[found.group_b]] = total + b + np.where(last_b, 2 * len(pair.bytes_b), 0)
        names = (pair.marked_a + pair.marked_b).__getitem__
        words = list(map(names, marked.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[i:j]) for i, j in zip([0, *ends[:-1]], ends)]


ALIGNED = pa.schema(
    [
        ("block", pa.int64()),
        ("regular", pa.bool_()),
        ("doc_id", pa.list_(pa.int64())),
        ("n_a", pa.list_(pa.int64())),
        ("n_b", pa.list_(pa.int64())),
        ("n_groups", pa.list_(pa.int64())),
        ("groups_sha256", pa.list_(pa.string())),
        ("doc_chunks", pa.list_(pa.int32())),
        ("chunk", pa.binary()),
        ("chunk_links", pa.binary()),
        ("link", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("pair_n", pa.list_(pa.int64())),
    ]
)
ALIGNED_DDL = (
    "block long, regular boolean, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "groups_sha256 array<string>, doc_chunks array<int>, chunk binary, chunk_links binary, link binary, "
    "pairs array<long>, pair_n array<long>"
)


def align_block(pair: Pair, rows: pa.RecordBatch, vector: np.ndarray) -> dict:
    """One block's row; its regular links are added to the vector, its irregular pairs are summed in the row."""
    number: dict[str, int] = {}
    owned: list[list[int]] = []
    for text in rows.column("text").to_pylist():
        owned.append([number.setdefault(c, len(number)) for c in pair.chunks(text)] if text else [])
    chunks = Chunks(pair, list(number))
    bad = set(np.flatnonzero(~chunks.good).tolist())
    if bad:
        owned = [[] if bad.intersection(x) else x for x in owned]
    doc_chunks = np.array([len(x) for x in owned], dtype=np.int64)
    chunk = np.fromiter(chain.from_iterable(owned), dtype=np.int64, count=int(doc_chunks.sum()))
    times = np.bincount(chunk, minlength=len(number))
    link_times = times[chunks.link_chunk]
    vector += np.bincount(chunks.link_a[chunks.regular], weights=link_times[chunks.regular], minlength=len(vector)).astype(np.int64)
    odd = ~chunks.regular
    pairs, place = np.unique((chunks.link_a[odd] << 32) + chunks.link_b[odd], return_inverse=True)
    link = -1 - chunks.link_a
    link[odd] = place
    spans = np.r_[0, np.cumsum(doc_chunks)]
    totals = {}
    for name, per_chunk in (("n_a", chunks.n_a), ("n_b", chunks.n_b), ("n_groups", chunks.n_groups)):
        totals[name] = np.diff(np.r_[0, np.cumsum(per_chunk[chunk])][spans])
    texts = chunks.texts.__getitem__
    return totals | {
        "regular": False,
        "doc_id": rows.column("doc_id").to_pylist(),
        "groups_sha256": [hashlib.sha256("".join(map(texts, x))[:-1].encode()).hexdigest() if x else "" for x in owned],
        "doc_chunks": doc_chunks,
        "chunk": B.compressed(chunk.astype(np.int32)),
        "chunk_links": B.compressed(chunks.n_links.astype(np.int32)),
        "link": B.compressed(link.astype(np.int32)),
        "pairs": pairs,
        "pair_n": np.bincount(place, weights=link_times[odd], minlength=len(pairs)).astype(np.int64),
    }


SCORED = pa.schema(
    [("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())]
)
SCORED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def score_block(row: dict, count: np.ndarray, best: np.ndarray, same_count: np.ndarray, same_best: np.ndarray) -> pa.RecordBatch:
    """The rows of a block's documents, from the counts of its irregular pairs and those of the regular ones."""
    chunk = B.numbers(row["chunk"], np.int32)
    link = B.numbers(row["link"], np.int32)
    chunk_links = B.numbers(row["chunk_links"], np.int32)
    spans = np.r_[0, np.cumsum(row["doc_chunks"].values.to_numpy(zero_copy_only=False), dtype=np.int64)]
    ends = np.r_[0, np.cumsum(chunk_links, dtype=np.int64)]
    regular = link < 0
    out = {"n_links": np.diff(np.r_[0, np.cumsum(chunk_links[chunk], dtype=np.int64)][spans])}
    for name, own, same in (("n_best", best, same_best), ("count_sum", count, same_count)):
        value = np.empty(len(link), dtype=np.int64)
        value[regular] = same[-1 - link[regular]]
        value[~regular] = own[link[~regular]]
        per_chunk = np.diff(np.r_[0, np.cumsum(value)][ends])
        out[name] = np.diff(np.r_[0, np.cumsum(per_chunk[chunk])][spans])
    return pa.RecordBatch.from_arrays(
        [pa.array(out[f.name]) if f.name in out else row[f.name].values.cast(f.type) for f in SCORED], schema=SCORED
    )


@dataclass
class Alignment:
    documents: DataFrame
    pairs: DataFrame  # (a, b, n, regular, best): how many links hold the pair, and whether no other A id has more with b


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_a: str | None = None,
    tokenizer_b: str | None = None,
    block_bytes: int = B.BLOCK_BYTES,
) -> Alignment:
    """Both tables of an alignment; ``documents`` has one row per input row, whatever its id.

    Null and empty texts, and texts that a tokenizer changes, have no tokens: zeros and an empty digest. Null and
    repeated ids are carried along. An empty table gives empty tables. Of the corpus the driver sees one count per
    id of A at most; all else stays in blocks, whose size ``block_bytes`` bounds unless one document is longer.
    """
    path_a, path_b = tokenizer_a or public_tokenizer(TOKENIZER_A), tokenizer_b or public_tokenizer(TOKENIZER_B)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared_pair(path_a, path_b)
        vector = np.zeros(len(pair.bytes_a), dtype=np.int64)
        for i, rows in enumerate(B.slices(batches, block_bytes)):
            yield B.one_row(ALIGNED, align_block(pair, rows, vector) | {"block": B.block_number(i)})
        seen = np.flatnonzero(vector)
        if len(seen):
            pairs = (seen << 32) + pair.same[seen]
            yield B.one_row(ALIGNED, {"block": -1, "regular": True, "pairs": pairs, "pair_n": vector[seen]})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            yield score_block(row, B.answers(row, "n", np.int64), B.answers(row, "best", np.int64), same_count, same_best)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(texts.mapInArrow(count, ALIGNED_DDL), "zstd")
    summed = rows.select("regular", F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).groupBy(F.col("p.pairs").alias("key"))
    totals = summed.agg(F.sum("p.pair_n").alias("n"), F.bool_or("regular").alias("regular"))
    totals = stored(totals.withColumns({"a": F.shiftright("key", 32), "b": F.col("key").bitwiseAND(2**32 - 1)}))
    most = totals.groupBy("b").agg(F.max("n").alias("most"))  # one row per id of B at most
    judged = totals.join(F.broadcast(most), "b").withColumn("best", F.col("n") == F.col("most"))
    same_rows = judged.where("regular").select("a", "n", "best").toPandas()  # one row per id of A at most
    size = int(same_rows["a"].max()) + 1 if len(same_rows) else 0
    same_count, same_best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    same_count[same_rows["a"].to_numpy(dtype=np.int64)] = same_rows["n"]
    same_best[same_rows["a"].to_numpy(dtype=np.int64)] = same_rows["best"]
    irregular = rows.where(~F.col("regular")).drop("regular", "pair_n")
    values = judged.select("key", "n", F.col("best").cast("long").alias("best"))
    documents = B.looked_up(irregular, "pairs", values, ["n", "best"]).mapInArrow(score, SCORED_DDL)
    return Alignment(documents, judged.select("a", "b", "n", "regular", "best"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents")).documents
