"""Best-fit packing of token sequences with a bounded number of open bins.

Documents are tokenised in Arrow batches. Their pieces (at most ``size`` tokens each) are spread over groups of a
fixed number of pieces, and each group is packed online by best fit, long pieces first: open bins are kept by free
space, a bitset over the free spaces finds the fullest bin that still takes a piece, and beyond ``open_bins`` the
fullest bin closes.
Bins still open when a group ends are packed again together in a second pass, so small remainders are not lost.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SIZE, END_ID = 4096, 1
OPEN_BINS, GROUP_PIECES = 512, 8192
#: Words and parts that a Python worker keeps, some 150 bytes each.
CACHED_WORDS = 600_000
TOKENIZER_FILE = "word_bpe_49k.json"


def public_tokenizer(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, str]:
    """Latin letters outside ASCII as the printable characters that byte-level vocabularies have for their bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    name = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {chr(c): "".join(name[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, for a lower-casing byte-level word tokenizer.

    Such a tokenizer never joins across white space, so words between white space are encoded once and kept, up to a
    bounded number; the first met are the common ones. Words of Latin letters with closing punctuation are two parts,
    whose letters go straight to the vocabulary's merges; any other word is encoded by the tokenizer as it is, and
    so are whole texts with a character that only Python takes for white space.
    """

    ODD = re.compile("[\x1c-\x1f]")
    LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = str.maketrans(byte_alphabet())
        self.cached = cached
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_letters(self, letters: str) -> bytes:
        found = self.parts.get(letters)
        if found is None:
            tokens = self.model.tokenize(letters.translate(self.alphabet))
            found = array("I", [t.id for t in tokens]).tobytes()
            if len(self.parts) < self.cached:
                self.parts[letters] = found
        return found

    def encode_word(self, word: str) -> bytes:
        split = self.LATIN.fullmatch(word)
        if not split:
            return self.encode(word)
        letters, marks = split.groups()
        ids = self.encode_letters(letters.lower())
        if marks:
            tail = self.parts.get(marks)
            if tail is None:
                tail = self.encode(marks)
                if len(self.parts) < self.cached:
                    self.parts[marks] = tail
            ids += tail
        return ids

    def ids(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self.encode(text)
        known, out = self.known, []
        for word in text.split():
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(known) < self.cached:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


_SHARED: dict[str, WordTokenizer] = {}


def shared_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that tasks run by the same worker share the known words."""
    if path not in _SHARED:
        _SHARED[path] = WordTokenizer(path)
    return _SHARED[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids and then ``end_id``, cut at ``size``."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    width = 4 * size

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_tokenizer(tokenizer)
        for batch in batches:
            owners, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for i in range(0, len(texts), 1000):
                rows = []
                for owner, text in zip(owners[i : i + 1000], texts[i : i + 1000]):
                    ids = encoder.ids(text) + end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        rows.append((owner, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class BestFit:
    """Online best fit over at most ``open_bins`` open bins; ``place`` gives the bin and the offset in it."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.limit = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.spaces = 0  # bit f is set if a bin with f free places is open
        self.count = self.bins = 0
        self.still_open: set[int] = set()

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.spaces ^= 1 << free
        self.count -= 1
        self.still_open.discard(found)
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self.take(free)
        else:
            free, found = self.size, self.bins
            self.bins += 1
        left = free - length
        if left:
            if self.count == self.limit:
                self.take((self.spaces & -self.spaces).bit_length() - 1)
            if not self.by_free[left]:
                self.spaces |= 1 << left
            self.by_free[left].append(found)
            self.count += 1
            self.still_open.add(found)
        return found, self.size - free


def pack(rows: DataFrame, n_groups: int, size: int, open_bins: int, pass_no: int) -> DataFrame:
    """Rows with sequence_id, offset and closed; groups are dealt by a hash of the piece and packed one by one."""

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "order", "doc_id", "piece", "ids_crc32"], ascending=False, ignore_index=True
        )
        bins = BestFit(size, open_bins)
        placed = [bins.place(n) for n in group["length"].tolist()]
        number = np.array([p[0] for p in placed], dtype=np.int64)
        group["sequence_id"] = (int(group["part"].iloc[0]) << 32) + (number << 1) + pass_no
        group["offset"] = np.array([p[1] for p in placed], dtype=np.int64)
        group["closed"] = [p[0] not in bins.still_open for p in placed]
        return group.drop(columns=["part", "order"])

    order = F.xxhash64("doc_id", "piece")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"
    dealt = rows.withColumn("order", order).withColumn("part", F.pmod("order", F.lit(n_groups)))
    return dealt.groupBy("part").applyInPandas(pack_group, schema)


def best_fit_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    size: int = SIZE,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and become one piece of the end id alone; only documents longer than ``size`` are cut.
    Null ids are carried along, rows of equal id are packed as documents of their own. Every piece is placed in
    exactly one sequence, whose offsets run gapless from 0. An empty table gives an empty result.
    """
    cut = stored(pieces(docs, id_col, text_col, tokenizer or public_tokenizer(), size, end_id))
    alone = cut.where(F.col("length") == size).select(
        "*", F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("offset")
    )
    full = alone.withColumn("sequence_id", -1 - F.col("row")).drop("row")
    part = cut.where(F.col("length") < size)
    first = stored(pack(part, -(-max(part.count(), 1) // group_pieces), size, open_bins, 0))
    again = first.where(~F.col("closed")).drop("sequence_id", "offset", "closed")
    second = pack(again, -(-max(again.count(), 1) // group_pieces), size, open_bins, 1)
    whole = full.unionByName(first.where("closed").drop("closed")).unionByName(second.drop("closed"))
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
