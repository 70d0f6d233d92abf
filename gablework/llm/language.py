"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Texts are lower-cased, everything but letters is a blank, and n-grams of one to three characters are counted in
hashed places. A sample of labelled rows, bounded per language, gives inverse document frequencies and, by spherical
k-means, several centroids per language; a text takes the language of the centroid with the largest cosine. A text that is
far from all centroids, compared with the labelled rows and their own language, is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

PLACES, CENTROIDS, ROUNDS = 2048, 4, 12
#: Bound on the labelled rows of each language that the classifier is fitted on: those with the least hash.
LANG_ROWS = 1000
#: A text is rejected below this share of the smallest cosine that a labelled row has with its own language.
REJECT_SHARE = 0.3
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, None if it is null or has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, np.uint32(32))
    code = np.concatenate([[np.uint32(32)], code, [np.uint32(32)]]).astype(np.uint32)
    code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]
    total = np.zeros(PLACES, dtype=np.int64)
    gram = np.zeros(len(code), dtype=np.uint32)
    for n in range(3):
        gram = gram[: len(code) - n] * np.uint32(0x01000193) + (code[n:] + np.uint32(n)) * np.uint32(0x9E3779B1)
        place = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        place = (place >> np.uint32(21))[code != 32] if n == 0 else place >> np.uint32(21)
        total += np.bincount(place, minlength=PLACES)
    return total


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Languages:
    weight: np.ndarray = field(default_factory=lambda: np.ones(PLACES, dtype=np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, PLACES), dtype=np.float32))
    names: list[str] = field(default_factory=list)
    least: float = 0.0

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return unit(np.log1p(rows.astype(np.float32)) * self.weight)

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(rows), np.zeros(len(rows))
        cosine = self.vectors(rows) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(rows)), best].astype(float), 0.0, 1.0)
        return [self.names[b] for b in best], score


def clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means, begun with the mean and then the row farthest from those taken."""
    chosen = [unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(rows)):
        nearest = (rows @ np.stack(chosen).T).max(axis=1)
        chosen.append(rows[int(nearest.argmin())])
    centroids = np.stack(chosen)
    for _ in range(ROUNDS):
        owner = (rows @ centroids.T).argmax(axis=1)
        held = [rows[owner == c] for c in range(len(centroids))]
        centroids = unit(np.stack([h.mean(axis=0) if len(h) else centroids[c] for c, h in enumerate(held)]))
    return centroids


def fit(labelled: list[tuple[str, np.ndarray]], k: int = CENTROIDS) -> Languages:
    if not labelled:
        return Languages()
    rows = np.stack([r for _, r in labelled])
    names = np.array([n for n, _ in labelled])
    held = (rows > 0).sum(axis=0)
    model = Languages(weight=(np.log((1 + len(rows)) / (1 + held)) + 1).astype(np.float32))
    vectors = model.vectors(rows)
    centroids, owners, least = [], [], 1.0
    for name in sorted(set(names.tolist())):
        own = vectors[names == name]
        found = clustered(own, k)
        centroids.append(found)
        owners += [name] * len(found)
        least = min(least, float((own @ found.T).max(axis=1).min()))
    model.centroids, model.names = np.concatenate(centroids).astype(np.float32), owners
    model.least = max(0.0, REJECT_SHARE * least)
    return model


def fit_languages(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lang_rows: int = LANG_ROWS
) -> Languages:
    """A model of the ``lang_rows`` labelled rows of each language with the least hash of id and text, or of all.

    However few rows of a language there are among the others, it is learned. Rows without id, language or letters
    are left out; rows of equal id, text and language count once. The driver holds the counts of the sampled rows,
    8 KB each before they are packed.
    """
    rows = labelled.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"),
        F.col(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).where(F.col(id_col).isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A cut of the hashes that leaves some more than are wanted, as the numbers are estimates; the driver cuts exactly.
    wanted = 1.4 * lang_rows + 100
    share = F.lit(wanted) / F.col("estimate")
    cuts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("estimate")).select(
        "lang", F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("long")).otherwise(2**63 - 1).alias("cut")
    )
    least = rows.join(F.broadcast(cuts), "lang").where(F.col("h") <= F.col("cut"))
    least = least.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column("text").to_pylist()]
            packed = [None if f is None else zlib.compress(f.astype("<u4").tobytes(), 1) for f in found]
            arrays = [batch.column("lang"), batch.column("h"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "h", "counts"])

    sample = least.select("lang", "h", "text").mapInArrow(vectorise, "lang string, h long, counts binary")
    sampled: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.collect():
        if r.counts:
            sampled.setdefault(r.lang, []).append((r.h, bytes(r.counts)))
    return fit(
        [
            (name, np.frombuffer(zlib.decompress(packed), dtype="<u4"))
            for name, held in sorted(sampled.items())
            for _, packed in sorted(held)[:lang_rows]
        ]
    )


def identify(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """All input columns and lang_pred, score, rejected, which replace input columns of the same name.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; any other text gets a learned
    language, and is rejected if its cosine is below the model's least. Long texts are read whole. Without labelled
    rows every text is ``und``. An empty table gives an empty result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [counts(t) for t in part.column(part.num_columns - 1).to_pylist()]
                known = [i for i, f in enumerate(found) if f is not None]
                names, scores, far = [UNKNOWN] * len(found), [0.0] * len(found), [True] * len(found)
                if known:
                    predicted, cosine = model.predict(np.stack([found[i] for i in known]))
                    for i, name, score in zip(known, predicted, cosine.tolist()):
                        names[i], scores[i], far[i] = name, score, name == UNKNOWN or score < model.least
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                arrays += [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "lang_pred", "score", "rejected"])

    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    own = docs.select(*columns)
    schema = own.schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*columns, F.col(text_col).alias(unused(docs, "whole_text"))).mapInArrow(judge, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained_on(docs: DataFrame) -> Languages:
    return fit_languages(docs.where(~held_out()))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), trained_on(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
