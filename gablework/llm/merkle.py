"""Merkle manifest of a dataset: hash trees of 16 children a node, kept as a postorder append log.

A tree's nodes are logged in the order in which they are completed: a node follows its last child. Where a node
stands follows from the number of leaves alone (``postorder``), so no pointers are kept, and a proof finds the
siblings of a leaf by their positions. Builders are aligned: each takes a whole subtree of up to 16^3 leaves, whose
nodes are one gapless piece of the log, and hands only its root to the builders above it, round by round. No builder
sees more than 4096 nodes, however many leaves a tree has.

Leaves are numbered by a range partitioning on (tree, order): rows of one tree may lie in many partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

FANOUT, BUILDER_LEVELS = 16, 3
TAMPER_MODULUS = 5
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def combined(digests: list[bytes]) -> bytes:
    """The parent of nodes: the hash of their digests written as lower-case hex."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def level_sizes(leaves: int, least: int = 0, fanout: int = FANOUT) -> list[int]:
    """Nodes per level up to the single one; a lone leaf is its own root. At least ``least`` levels above the leaves."""
    sizes = [leaves]
    while sizes[-1] > 1 or len(sizes) <= least:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


def postorder(level: int, index: int, sizes: list[int], fanout: int = FANOUT) -> int:
    """Position of a node in the log of a tree with so many nodes per level, from the subtrees before it.

    With ``end`` leaves up to the node's last one, all nodes of lower levels and of its own that end there are
    written; of higher levels those that end before it.
    """
    end = min((index + 1) * fanout**level, sizes[0])
    below = sum(-(-end // fanout**j) for j in range(level + 1))
    return below + sum((end - 1) // fanout**j for j in range(level + 1, len(sizes))) - 1


class Builder:
    """Appends the nodes of an aligned run of leaves in the order of their completion."""

    def __init__(self, levels: int, more: bool, fanout: int = FANOUT):
        self.fanout, self.levels, self.more = fanout, levels, more
        self.open: list[list[bytes]] = [[] for _ in range(levels + 1)]
        self.log: list[bytes] = []

    def append(self, digest: bytes) -> None:
        level = 0
        while True:
            self.log.append(digest)
            run = self.open[level]
            run.append(digest)
            if level == self.levels or len(run) < self.fanout:
                return
            digest, self.open[level] = combined(run), []
            level += 1

    def close(self) -> bytes:
        """Completes what is open and returns the run's root: of all ``levels`` if the tree goes on above it."""
        for level in range(self.levels):
            run = self.open[level]
            top = len(run) == 1 and not any(self.open[level + 1 :]) and not self.more
            if run and not top:
                self.open[level] = []
                self.log.append(combined(run))
                self.open[level + 1].append(self.log[-1])
        return self.log[-1]


def siblings(log: bytes, sizes: list[int], index: int, fanout: int = FANOUT) -> list[tuple[int, list[bytes]]]:
    """Per level below the top: the place of the leaf's node in its run, and the run's others, read by position."""
    found = []
    for level in range(len(sizes) - 1):
        first = index // fanout * fanout
        at = [32 * postorder(level, k, sizes, fanout) for k in range(first, min(first + fanout, sizes[level])) if k != index]
        found.append((index - first, [log[x : x + 32] for x in at]))
        index //= fanout
    return found


def piece_sizes(piece: dict, per: int, levels: int) -> list[int]:
    """Nodes per level of a builder's piece, which goes up all its levels where the tree goes on above it."""
    return level_sizes(piece["size"], levels if piece["leaves"] > per else 0)


def paths_of(piece: dict, per: int, levels: int) -> list[bytes]:
    """The packed paths of a piece's leaves, up to the tree's root."""
    sizes = piece_sizes(piece, per, levels)
    return [packed(siblings(piece["log"], sizes, i)) + (piece["above"] or b"") for i in range(piece["size"])]


def fold(digest: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that follows from a leaf and the siblings of its path."""
    for place, others in path:
        digest = combined([*others[:place], digest, *others[place:]])
    return digest


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in path)


def unpacked(path: bytes) -> list[tuple[int, list[bytes]]]:
    found, at = [], 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        at += 2
        found.append((place, [path[at + 32 * i : at + 32 * i + 32] for i in range(count)]))
        at += 32 * count
    return found


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows with ``i``, their number from 0 in their tree by the order, and ``leaves``, the tree's size.

    Range partitioning also splits one tree, and rows of equal order by a number of their own; each partition's rows
    are counted per tree, and the counts before it are added. Nulls come first.
    """
    split = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = split.repartitionByRange(tree, *order, "_row").sortWithinPartitions(tree, *order, "_row").drop("_row")
    at = F.monotonically_increasing_id()
    placed = stored(placed.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(2**33 - 1)}))
    counts = placed.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_tree").orderBy("_of")
    starts = stored(
        counts.select(
            "_tree",
            "_of",
            "_first",
            (F.sum("_n").over(before) - F.col("_n")).alias("_start"),
            F.sum("_n").over(Window.partitionBy("_tree")).alias("leaves"),
        )
    )
    joined = placed.join(starts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("i", F.col("_at") - F.col("_first") + F.col("_start")).drop("_part", "_at", "_of", "_tree", "_first", "_start")


PIECE = "tree long, block long, leaves long, size long, log binary, root binary"


def build(nodes: DataFrame, per_builder: int, levels: int, extra: list[str]) -> DataFrame:
    """One round: (tree, block, leaves, size, log, root) of each aligned run, with ``extra`` arrays of its rows.

    ``nodes`` has (tree, i, digest, leaves, *extra), ``leaves`` being the number of this round's nodes in the tree.
    """
    runs = nodes.groupBy("tree", F.expr(f"i div {per_builder}").alias("block")).agg(
        F.first("leaves").alias("leaves"), F.array_sort(F.collect_list(F.struct("i", "digest", *extra))).alias("run")
    )
    inputs = runs.select("tree", "block", "leaves", F.size("run").cast("long").alias("size"), F.col("run.digest").alias("digests"), *[F.col(f"run.{c}").alias(c) for c in extra])
    carried = {f.name: f.dataType.simpleString() for f in inputs.schema if f.name in extra}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, roots = [], []
            for run, leaves in zip(batch.column("digests"), batch.column("leaves").to_pylist()):
                builder = Builder(levels, leaves > per_builder)
                for digest in run.values.to_pylist():
                    builder.append(digest)
                roots.append(builder.close())
                logs.append(b"".join(builder.log))
            columns = {n: batch.column(n) for n in ("tree", "block", "leaves", "size")}
            columns |= {"log": pa.array(logs, pa.binary()), "root": pa.array(roots, pa.binary())}
            columns |= {c: batch.column(c) for c in extra}
            yield pa.RecordBatch.from_pydict(columns)

    return stored(inputs.mapInArrow(write, ", ".join([PIECE, *[f"{c} {kind}" for c, kind in carried.items()]])))


NODES = pa.schema([("tree", pa.int64()), ("position", pa.int64()), ("level", pa.int32()), ("node", pa.int64()), ("digest", pa.binary())])
NODES_DDL = "tree long, position long, level int, node long, digest binary"


@dataclass
class Forest:
    """Hash trees. ``pieces`` are the log's lowest pieces with the leaves' extra arrays and ``above``, the path from
    their root to the tree's; ``rounds`` are all pieces by round; ``roots`` has (tree, root, count)."""

    pieces: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    per_builder: int
    levels: int

    def log(self) -> DataFrame:
        """(tree, position, level, node, digest): the whole log, one row per node."""
        per, levels = self.per_builder, self.levels

        def nodes(start: int):
            """A round's nodes; its leaves are the roots of the round below, which has them already."""

            def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for piece in batch.to_pylist():
                        sizes, whole, out = piece_sizes(piece, per, levels), level_sizes(piece["total"]), []
                        for level in range(1 if start else 0, len(sizes)):
                            first = piece["block"] * per // FANOUT**level
                            for k in range(sizes[level]):
                                at = 32 * postorder(level, k, sizes)
                                place = postorder(start + level, first + k, whole)
                                out.append((piece["tree"], place, start + level, first + k, piece["log"][at : at + 32]))
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], f.type) for c, f in enumerate(NODES)], schema=NODES)

            return spread

        total = self.rounds[0].select("tree", F.col("leaves").alias("total")).distinct()
        parts = [
            r.select("tree", "block", "leaves", "size", "log").join(total, "tree").mapInArrow(nodes(levels * k), NODES_DDL)
            for k, r in enumerate(self.rounds)
        ]
        return reduce(DataFrame.unionByName, parts)


def grow(leaves: DataFrame, extra: list[str], levels: int = BUILDER_LEVELS) -> Forest:
    """The trees over (tree, i, digest, leaves, *extra), built bottom-up and then given their paths top-down.

    There is one round per ``levels`` levels: three for up to 16^9 leaves in a tree. Trees that are done leave the
    rounds. Paths go down piece by piece, to at most 4096 pieces from each, so no position is asked for by all leaves.
    """
    per = FANOUT**levels
    rounds, nodes, carried = [], leaves, extra
    while True:
        pieces = build(nodes, per, levels, carried)
        rounds.append(pieces)
        rest = pieces.where(F.col("leaves") > per)
        if rest.isEmpty():
            break
        upper = F.expr(f"(leaves + {per - 1}) div {per}")
        nodes, carried = rest.select("tree", F.col("block").alias("i"), F.col("root").alias("digest"), upper.alias("leaves")), []
    roots = reduce(DataFrame.unionByName, [p.where(F.col("leaves") <= per).select("tree", "root") for p in rounds])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                paths, first = paths_of(piece, per, levels), piece["block"] * per
                numbers = range(first, first + len(paths))
                yield pa.RecordBatch.from_pydict({"tree": [piece["tree"]] * len(paths), "block": list(numbers), "above": paths})

    def with_paths(pieces: DataFrame, above: DataFrame | None) -> DataFrame:
        if above is None:
            return pieces.withColumn("above", F.lit(None).cast("binary"))
        return pieces.join(above, ["tree", "block"], "left")

    above = None
    for pieces in reversed(rounds[1:]):
        own = with_paths(pieces.select("tree", "block", "leaves", "size", "log"), above)
        above = stored(own.mapInArrow(descend, "tree long, block long, above binary"))
    return Forest(with_paths(rounds[0], above), rounds, roots, per, levels)


@dataclass
class Manifest:
    """``forest``: a tree per source; ``sources``: (source, tree, subroot, path, root), the path going from the
    subroot to the root; ``proofs`` checks every document."""

    forest: Forest
    sources: DataFrame

    def log(self) -> DataFrame:
        """(source, position, level, node, digest) of every node below and with the subroots."""
        return self.forest.log().join(self.sources.select("tree", "source"), "tree").drop("tree")

    def proofs(self) -> DataFrame:
        per, levels = self.forest.per_builder, self.forest.levels

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    yield proved({n: batch.column(n)[k] for n in batch.schema.names}, per, levels)

        pieces = self.forest.pieces.join(self.sources.drop("source"), "tree")
        return pieces.mapInArrow(prove, PROOF_DDL)


PROOF_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proved(piece: dict, per: int, levels: int) -> pa.RecordBatch:
    """The rows of one piece's documents: proof by position, and the root folded from the leaf as it is stored now."""
    log, size = piece["log"].as_py(), piece["size"].as_py()
    sizes = piece_sizes({"size": size, "leaves": piece["leaves"].as_py()}, per, levels)
    root = piece["root_digest"].as_py()
    above = unpacked((piece["above"].as_py() or b"") + (piece["path"].as_py() or b""))
    upper = b"".join(d for _, others in above for d in others).hex().encode()
    rows: dict[str, list] = {"doc_id": piece["doc_id"].as_py(), "leaf": [], "proof_sha256": [], "folded_root": [], "verified": []}
    seen: dict[bytes, bytes] = {}  # tampered or not, leaves of a run fold to few different nodes above it
    for i, now in enumerate(piece["stored"].as_py()):
        path = siblings(log, sizes, i)
        own = b"".join(d for _, others in path for d in others).hex().encode()
        at = postorder(0, i, sizes)
        node = fold(now, path)
        if node not in seen:
            seen[node] = fold(node, above)
        rows["leaf"].append(log[32 * at : 32 * at + 32].hex())
        rows["proof_sha256"].append(hashlib.sha256(own + upper).hexdigest())
        rows["folded_root"].append(seen[node].hex())
        rows["verified"].append(seen[node] == root)
    rows |= {"subroot": [piece["subroot"].as_py().hex()] * size, "root": [root.hex()] * size}
    names = [part.split()[0] for part in PROOF_DDL.split(", ")]
    kinds = {"doc_id": pa.int64(), "verified": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.string())) for n in names], names=names)


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = BUILDER_LEVELS) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are not looked at).

    Leaves of a source ascend by doc_id, null first, and by digest where ids are equal; a null source is a tree of
    its own and the first. ``tampered`` marks rows whose text is lower-cased (A-Z) after the manifest was made. An
    empty table has no trees, and no proofs.
    """
    ids, source, lang, n_chars, text = [F.col(c) for c in COLUMNS]
    digest = leaf_digest(ids, source, lang, n_chars, text)
    if tampered is None:
        now = digest
    else:
        now = F.when(F.coalesce(tampered, F.lit(False)) & text.isNotNull(), leaf_digest(ids, source, lang, n_chars, ascii_lower(text))).otherwise(digest)
    leaves = docs.select(ids.cast("long").alias("doc_id"), source.cast("string").alias("source"), digest.alias("digest"), now.alias("stored"))
    rows = numbered(leaves, "source", ["doc_id", "digest"])
    trees = numbered(rows.select("source", F.lit(0).alias("all")).distinct(), "all", ["source"])
    trees = stored(trees.select(F.col("source").alias("of"), F.col("i").alias("tree")))
    named = rows.join(trees, F.col("source").eqNullSafe(F.col("of"))).select("tree", "i", "digest", "leaves", "doc_id", "stored")
    forest = grow(named, ["doc_id", "stored"], levels)
    tops = forest.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("root").alias("digest"), F.col("root").alias("subroot"), F.col("tree").alias("own"))
    sizes = tops.groupBy("tree").agg(F.count("*").alias("leaves"))
    crown = grow(tops.join(sizes, "tree"), ["subroot", "own"], levels)
    per = crown.per_builder

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                paths = paths_of(piece, per, levels)
                whole = [piece["tree"]] * len(paths)
                yield pa.RecordBatch.from_pydict({"crown": whole, "tree": piece["own"], "subroot": piece["subroot"], "path": paths})

    root = stored(crown.roots.select(F.col("tree").alias("crown"), F.col("root").alias("root_digest")))
    paths = crown.pieces.mapInArrow(descend, "crown long, tree long, subroot binary, path binary").join(root, "crown").drop("crown")
    return Manifest(forest, stored(paths.join(trees.withColumnRenamed("of", "source"), "tree")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return manifest(table(spark, sf_dir, "documents"), F.pmod(crc, F.lit(TAMPER_MODULUS)) == 0).proofs()


def merkle_sql(levels: int = 8) -> str:
    """The same by joins, level by level; ``levels`` levels hold 16^levels leaves in a tree and as many sources."""

    def value(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    start = " || ".join(value(c) for c in COLUMNS[:-1])
    parts = [
        f"""
d AS (
  SELECT doc_id, source, sha256({start} || {value('text')}) AS leaf,
         CASE WHEN list_reduce(
             list_prepend(4294967295::BIGINT, flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[] FOR c IN string_split(doc_id::VARCHAR, '')])),
             lambda acc, x: CASE WHEN xor(acc, x) & 1 = 1 THEN xor(xor(acc, x) >> 1, 3988292384) ELSE xor(acc, x) >> 1 END
           ).xor(4294967295) % {TAMPER_MODULUS} = 0
           THEN sha256({start} || {value(lower)})
           ELSE sha256({start} || {value('text')}) END AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
         dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree
  FROM documents),
a0 AS (SELECT tree, i, leaf AS h FROM d)"""
    ]

    def climb(name: str, first: str) -> None:
        for k in range(levels):
            own = f"{name}{k}" if k else first
            parts.append(
                f"""
{name}{k + 1} AS (
  SELECT tree, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {own}) GROUP BY tree, i // 16)"""
            )

    def prove(name: str, first: str, rows: str) -> None:
        """Per document: what stands beside its node, and the node folded from what is stored now."""
        for k in range(levels):
            own = f"{name}{k}" if k else first
            last = rows if k == 0 else f"{name}p{k}"
            parts.append(
                f"""
{name}p{k + 1} AS (
  SELECT p.doc_id, p.tree, any_value(p.i) // 16 AS i,
         any_value(p.proof) || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> p.i), '') AS proof,
         CASE WHEN any_value(s.n) = 1 THEN any_value(p.now)
              ELSE sha256(string_agg(CASE WHEN s.i = p.i THEN p.now ELSE s.h END, '' ORDER BY s.i)) END AS now
  FROM {last} p JOIN (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {own}) s
    ON s.tree = p.tree AND s.i // 16 = p.i // 16
  GROUP BY p.doc_id, p.tree)"""
            )

    climb("a", "a0")
    parts.append(f"\nb0 AS (SELECT 0 AS tree, tree AS i, h FROM a{levels})")
    climb("b", "b0")
    parts.append("\nstarts AS (SELECT doc_id, tree, i, now, '' AS proof FROM d)")
    prove("a", "a0", "starts")
    parts.append(f"\ntops AS (SELECT doc_id, 0 AS tree, tree AS i, now, proof FROM ap{levels})")
    prove("b", "b0", "tops")
    return f"""WITH {','.join(parts)}
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.now AS folded_root, p.now = r.h AS verified
FROM d JOIN a{levels} s ON s.tree = d.tree JOIN b{levels} r ON true JOIN bp{levels} p ON p.doc_id = d.doc_id
"""


MERKLE_SQL = merkle_sql()
