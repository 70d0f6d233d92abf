"""N-gram Jaccard join over word shingles by MinHash banding.

A tree is a band: its label is one hash of a fixed number of MinHash values, the most at which the expected recall at
the threshold reaches the target, and texts of equal label in some tree are candidates. There is no LSH forest: no
sorted signatures and no prefixes shortened by what matches, as the threshold is the same for all pairs and one depth
gives each link the wanted recall. Candidates are verified on whole shingle sets. Equal sets are one node
with a weight; nodes of one prefix are compared in blocks that give back, per node, its weighted number of links and
one link towards a common root, never the pairs themselves. A pair is compared only in the first tree that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stored, table, unused
from .terms import WordHashes, shingles, words_of

WIDTH, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL = 32, 12, 0.9999
BLOCK = 256
#: Sets held by at least this fraction (1 / HOT_SETS) of the rows are joined by broadcast.
HOT_SETS = 1000
#: Shingles hashed at once, pairs and columns compared at once: bounds of the arrays in a worker.
HASHED, PAIRS, COLUMNS = 512, 2048, 8192


def recall_at(depth: int, trees: int, similarity: float) -> float:
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(trees: int, max_depth: int, similarity: float, recall: float) -> int:
    """The most values a label, one number for all texts, with the wanted recall at the given similarity."""
    depth = max_depth
    while depth > 1 and recall_at(depth, trees, similarity) < recall:
        depth -= 1
    return depth


class Forest:
    """Labels (prefixes of fixed depth) of a shingle set in every band, as hashes of depth MinHash values each."""

    def __init__(self, trees: int, depth: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factors = draw.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prefixes(self, items: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(items), HASHED):
            np.minimum(least, (items[at : at + HASHED, None] * self.factors[None, :]).min(axis=0), out=least)
        steps = least.reshape(self.trees, self.depth)
        path = np.arange(1, self.trees + 1, dtype=np.uint64)
        for k in range(self.depth):
            path = (path ^ steps[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            path ^= path >> np.uint64(29)
        return path


_SHARED: dict[str, WordHashes] = {}


def shared_hashes() -> WordHashes:
    return _SHARED.setdefault("words", WordHashes())


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered i[k] and j[k]."""
    if len(i) <= 2 * len(sets) and len(i) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    found = np.zeros(len(i), dtype=np.int64)
    for left in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [left, left + COLUMNS])
        bits = np.zeros((len(sets), COLUMNS), dtype=bool)
        bits[owner[lo:hi], column[lo:hi] - left] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            found[at : at + PAIRS] += np.bitwise_count(packed[a] & packed[b]).sum(axis=1, dtype=np.int64)
    return found


def links_of_block(
    tree: int,
    homes: np.ndarray | None,
    weights: np.ndarray,
    prefixes: np.ndarray,
    sets: list[np.ndarray],
    threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Per node the weight of its links found here, and the number of the node that stands for its linked group.

    With ``homes`` only nodes of different homes are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    i, j = np.triu_indices(n, 1)
    keep = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    if homes is not None:
        keep &= homes[i] != homes[j]
    i, j = i[keep], j[keep]
    for t in range(tree):
        apart = prefixes[i, t] != prefixes[j, t]
        i, j = i[apart], j[apart]
    weight, root = np.zeros(n, dtype=np.int64), np.arange(n)
    if not len(i):
        return weight, root
    both = intersections(sets, i, j)
    linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    i, j = i[linked], j[linked]
    np.add.at(weight, i, weights[j])
    np.add.at(weight, j, weights[i])
    while len(i):  # the least number of a group spreads over its links
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    return weight, root


def nodes(docs: DataFrame, forest: Forest, width: int) -> DataFrame:
    """(doc_id, digest, n, prefixes) per row: digest of the shingle set, its size, a prefix for each tree."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                digests, sizes, paths = [], [], []
                for text in part.column("text").to_pylist():
                    items = shingles(words_of(text), hashes, width)
                    digests.append(set_digest(items))
                    sizes.append(len(items))
                    paths.append(forest.prefixes(items).view(np.int64) if len(items) else np.empty(0, np.int64))
                ends = np.cumsum([0, *map(len, paths)], dtype=np.int32)
                values = np.concatenate(paths) if paths else np.empty(0, np.int64)
                columns = [
                    part.column("doc_id"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "prefixes"])

    return docs.mapInArrow(sign, "doc_id long, digest binary, n long, prefixes array<bigint>")


def members(docs: DataFrame, wanted: DataFrame, forest: Forest, width: int) -> DataFrame:
    """(digest, weight, items, prefixes) of the wanted nodes, their sets computed again from one row of each."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200).to_pydict()
                out: dict[str, list] = {"digest": [], "weight": [], "items": [], "prefixes": []}
                for text, digest, weight in zip(part["text"], part["digest"], part["weight"]):
                    items = shingles(words_of(text), hashes, width)
                    if set_digest(items) == digest:  # rows of equal id may have other texts
                        row = (digest, weight, items.tobytes(), forest.prefixes(items).tobytes())
                        for name, value in zip(out, row):
                            out[name].append(value)
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    rows = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["min_id"])).select("text", "digest", "weight")
    found = rows.mapInArrow(expand, "digest binary, weight long, items binary, prefixes binary")
    return found.dropDuplicates(["digest"])


def compare_blocks(rows: DataFrame, trees: int, threshold: float) -> DataFrame:
    """(digest, root, weight) for every node with links in some block."""
    key = ["tree", "prefix", "low", "high"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(part: pd.DataFrame) -> pd.DataFrame:
            digests = part["digest"].tolist()
            one = part.iloc[0]
            weight, root = links_of_block(
                int(one["tree"]),
                None if one["low"] == one["high"] else part["home"].to_numpy(),
                part["weight"].to_numpy(),
                np.stack([np.frombuffer(p, dtype=np.uint64) for p in part["prefixes"]]),
                [np.frombuffer(s, dtype=np.uint64) for s in part["items"]],
                threshold,
            )
            kept = np.flatnonzero(weight)
            return pd.DataFrame(
                {
                    "digest": [digests[k] for k in kept],
                    "root": [digests[root[k]] for k in kept],
                    "weight": weight[kept],
                }
            )

        held: list[pd.DataFrame] = []  # rows of the block that the last batch ended in
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            if held and (held[-1][key].to_numpy()[-1] != keys[0]).any():
                yield block(pd.concat(held, ignore_index=True))
                held = []
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = batch.iloc[lo:hi]
                if hi == len(batch):
                    held.append(part)
                elif held:
                    found.append(block(pd.concat([*held, part], ignore_index=True)))
                    held = []
                elif hi - lo > 1:
                    found.append(block(part))
            if found:
                yield pd.concat(found, ignore_index=True)
        if held:
            yield block(pd.concat(held, ignore_index=True))

    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInPandas(compare, "digest binary, root binary, weight long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): nodes joined by edges get the same label. Contracts the graph until no edge is left.

    Each round sends every node to the least of its neighbours and itself; as nodes are digests, their order is
    random and a constant share of the nodes goes in each round, whatever the form of the graph.
    """
    edges = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("parent")))
        if labels is None:
            labels = parents.withColumnRenamed("parent", "label")
        else:
            joined = labels.join(parents.withColumnRenamed("node", "label"), "label", "left")
            labels = stored(joined.select("node", F.coalesce("parent", "label").alias("label")))
        left = edges.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        left = left.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        edges = stored(left.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, class_size.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``threshold``; a class is a set of documents connected by links, class_id its least doc_id, n_links the number
    of other documents linked to this one, copies included. A text of fewer words than ``width`` is one shingle.
    Null texts and texts without words link to nothing and are classes of their own. Rows of equal id are separate
    documents; a null id is carried along and never names a class unless all its ids are null. An empty table gives
    an empty result. ``recall`` is the expected share of the links right at the threshold that are found.
    """
    forest = Forest(trees, prefix_depth(trees, MAX_DEPTH, threshold, recall))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(nodes(docs, forest, width))
    filled = signed.where("n > 0")
    weighted = filled.groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("weight"))
    weighted = stored(weighted)

    entries = filled.select("digest", F.posexplode("prefixes").alias("tree", "prefix")).distinct()
    entries = stored(entries)
    buckets = entries.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("digest")).alias("x"),
        F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"),
    )
    # Prefixes with the same members in several trees are compared once, in the first of these trees.
    buckets = buckets.where("n > 1").groupBy("n", "x", "y").agg(
        F.min("tree").alias("tree"), F.min_by("prefix", "tree").alias("prefix")
    )
    live = stored(entries.join(buckets.select("tree", "prefix", "n"), ["tree", "prefix"]))
    wanted = weighted.join(live.select("digest").distinct(), "digest")
    found = members(docs, wanted, forest, width)

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    homed = live.withColumn("blocks", blocks).withColumn("home", F.pmod(F.hash("digest"), "blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = homed.select("digest", "tree", "prefix", "home", other)
    spread = spread.withColumn("low", F.least("home", "other")).withColumn("high", F.greatest("home", "other"))
    links = stored(compare_blocks(spread.drop("other").join(found, "digest"), trees, threshold))

    labels = components(links, "digest", "root")
    counts = links.groupBy("digest").agg(F.sum("weight").alias("others"))
    named = weighted.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "label", F.coalesce("label", "digest")
    )
    classes = named.groupBy("label").agg(F.min("min_id").alias("class_id"), F.sum("weight").alias("class_size"))
    described = named.join(classes, "label").join(counts, "digest", "left")
    described = stored(described.select(
        "digest", "weight", "class_id", "class_size", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    ))
    alone = signed.where("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size")
    )
    # Sets with many copies are described by broadcast: at most HOT_SETS have that share of the rows.
    is_hot = F.col("weight") * HOT_SETS >= max(signed.count(), 1)
    hot, light = described.where(is_hot), described.where(~is_hot)
    rows = filled.select("doc_id", "digest")
    some = F.broadcast(hot.select("digest"))
    copies = rows.join(F.broadcast(hot), "digest")
    grouped = copies.unionByName(rows.join(some, "digest", "left_anti").join(light, "digest"))
    return grouped.select("doc_id", "class_id", "n_links", "class_size").unionByName(alone)


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that name their class, and those without an id; all columns unchanged."""
    name = unused(docs, "gone_id")
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")


def near_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near duplicates, all columns unchanged: the one of least id, a null id coming last and
    one of rows that share it. Rows are told apart by a number, so ids may be null or repeated. Rows without words stay."""
    rows, row = numbered(docs)
    classes = jaccard_join(rows, id_col=row, text_col=text_col).select(F.col("doc_id").alias("member"), "class_id")
    ids = rows.select(F.col(row).alias("member"), F.col(id_col).cast("long").alias("own"))
    placed = stored(classes.join(ids, "member"))
    first = F.min_by("member", F.struct(F.col("own").isNull(), "own", "member")).alias("kept")
    gone = placed.join(placed.groupBy("class_id").agg(first), "class_id").where("member <> kept").select(F.col("member").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
numbered AS (SELECT doc_id, hash(s) AS s FROM shingle),
sizes AS (SELECT doc_id, count(*) AS n FROM numbered GROUP BY 1),
both_have AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM numbered x JOIN numbered y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM both_have p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * p.n >= 4 * (x.n + y.n - p.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY 1)
SELECT doc_id, class_id, coalesce(k, 0) AS n_links, class_size
FROM class LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY 1) USING (doc_id)
"""
