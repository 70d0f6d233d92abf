import hashlib
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from cases import TEXTS, clashing, documents, rows_of
from gablework.llm.merkle import Builder, combined, fold, level_sizes, manifest, postorder, siblings
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def naive_log(leaves, fanout=16):
    """(level, index, digest) in postorder, by recursion from the top."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([combined(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    out = []

    def visit(level, index):
        if level:
            for k in range(index * fanout, min((index + 1) * fanout, len(levels[level - 1]))):
                visit(level - 1, k)
        out.append((level, index, levels[level][index]))

    visit(len(levels) - 1, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 273, 300, 4095, 4096])
def test_positions_builder_and_proofs(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    expected, sizes = naive_log(leaves), level_sizes(n)
    assert [postorder(level, i, sizes) for level, i, _ in expected] == list(range(len(expected)))
    builder = Builder(3, more=False)
    for leaf in leaves:
        builder.append(leaf)
    assert builder.close() == expected[-1][2] and builder.log == [d for _, _, d in expected]
    log = b"".join(builder.log)
    for i in {0, n // 2, n - 1}:
        assert fold(leaves[i], siblings(log, sizes, i)) == expected[-1][2]
        assert n == 1 or fold(leaves[i - 1], siblings(log, sizes, i)) != expected[-1][2]


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain(rows, tampered):
    """The contract in plain Python: (doc_id, leaf, subroot, root, proof, folded, verified) per row."""

    def climb(digests):
        """The root and, per leaf, the runs that it passes with its place in them."""
        level, paths = digests, [[] for _ in digests]
        node = list(range(len(digests)))
        while len(level) > 1:
            for leaf, at in enumerate(node):
                paths[leaf].append((at % 16, level[at // 16 * 16 : at // 16 * 16 + 16]))
            level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
            node = [at // 16 for at in node]
        return level[0], paths

    trees = {}
    for row in rows:
        leaf = H(*map(field, row))
        text = row[4].translate(LOWER) if row[4] is not None and tampered(row[0]) else row[4]
        trees.setdefault(row[1], []).append((row[0], leaf, H(*map(field, (*row[:4], text)))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = {name: climb([r[1] for r in trees[name]]) for name in names}
    root, crown = climb([tops[name][0] for name in names]) if names else ("", [])
    out = []
    for k, name in enumerate(names):
        for (doc_id, leaf, now), path in zip(trees[name], tops[name][1]):
            proof = ""
            for place, run in [*path, *crown[k]]:
                proof += "".join(run[:place] + run[place + 1 :])
                now = H(*run[:place], now, *run[place + 1 :])
            out.append((doc_id, leaf, tops[name][0], root, H(proof), now, now == root))
    return sorted(out, key=repr)


def crc_fifth(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def tampered_column():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_matches_plain_python(spark, levels):
    rows = [(i, f"s{i % 3}" if i % 2 else "hot", "en" if i % 5 else None, i, f"Text {i} É") for i in range(700)]
    rows += [(i, f"own {i}", None, None, None) for i in range(40)] + [(None, None, None, None, None)] * 3
    rows += [(7, "twice", "de", 1, "A"), (7, "twice", "de", 1, "A"), (7, "twice", "de", 1, "B"), (None, "twice", "de", 1, "C"), (1, "", "x", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    made = manifest(clashing(docs), tampered_column(), levels=levels)
    assert rows_of(made.proofs()) == plain(rows, crc_fifth)
    hot = [r for r in made.log().where("source = 'hot'").orderBy("position").collect()]
    leaves = [bytes.fromhex(H(*map(field, r))) for r in sorted((r for r in rows if r[1] == "hot"), key=lambda r: r[0])]
    assert [(r.level, r.node, bytes(r.digest)) for r in hot] == naive_log(leaves)
    assert [r.position for r in hot] == list(range(len(hot)))


def test_untampered_rows_verify(spark):
    found = manifest(documents(spark, TEXTS)).proofs().collect()
    assert len(found) == len(TEXTS) and all(r.verified for r in found)


def test_one_row_is_its_own_root(spark):
    row = manifest(documents(spark, [(1, "Only one")])).proofs().first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == H("")


def test_empty_table(spark):
    made = manifest(documents(spark).limit(0))
    assert made.proofs().count() == 0 and made.log().count() == 0
