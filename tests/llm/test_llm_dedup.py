import hashlib
import random
from collections import defaultdict

import pytest
from cases import TEXTS, clashing, documents, rows_of
from gablework.llm.exact_dedup import exact_dedup, misra_gries
from gablework.llm.jaccard_join import Forest, jaccard_join, keep_one, links_of_block, prefix_depth, recall_at
from gablework.llm import line_dedup as line_dedups
from gablework.llm.line_dedup import allowed, entries_of, finer_entries, line_dedup, places, segments, within_edits
from gablework.llm.terms import WordHashes, shingles, words_of
from pyspark.sql import functions as F

import numpy as np


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_misra_gries_keeps_every_frequent_value():
    draw = random.Random(1)
    values = [draw.choice("abcdefghij") if draw.random() < 0.6 else draw.randrange(10**6) for _ in range(5000)]
    kept = misra_gries(values, 20)
    assert len(kept) <= 20
    for v in set(values):
        if values.count(v) > len(values) / 21:
            assert values.count(v) - len(values) / 21 <= kept[v] <= values.count(v)


@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_exact_dedup_against_plain_groups(spark, counters):
    found = rows_of(exact_dedup(clashing(documents(spark)), counters=counters))
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[ascii_lower(t)].append(i)
    assert len(found) == len(TEXTS)
    assert sum(r[3] for r in found) == len(groups)
    for doc_id, keep_id, size, kept, digest in found:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == digest)
        ids = [i for i in own if i is not None]
        assert size == len(own) and keep_id == (max(ids) if ids else None)
        assert not kept or doc_id == keep_id


def test_exact_dedup_of_no_rows(spark):
    assert exact_dedup(documents(spark, [])).count() == 0


# ---- n-gram Jaccard join


def plain_classes(rows, threshold=0.8):
    hashes = WordHashes()
    sets = [set(shingles(words_of(t), hashes).tolist()) for _, t in rows]
    n = len(rows)
    links = [
        [b for b in range(n) if b != a and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
        for a in range(n)
    ]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], min(ids) if ids else None, len(links[a]), len(seen)))
    return sorted(out, key=repr)


def test_shingles_follow_the_word_rule():
    assert words_of("A-b C_d é1\u00a0x ſ") == [b"a", b"b", b"c", b"d", "é1\u00a0x".encode(), "ſ".encode()]
    assert len(shingles([], WordHashes())) == 0
    assert len(shingles([b"a"], WordHashes())) == 1
    assert len(shingles([b"a"] * 9, WordHashes())) == 1
    assert len(shingles([b"a", b"b", b"c", b"d", b"e", b"f"], WordHashes())) == 2


def test_prefixes_are_cut_until_the_recall_is_met():
    depth = prefix_depth(32, 12, 0.8, 0.9999)
    assert recall_at(depth, 32, 0.8) >= 0.9999 > recall_at(depth + 1, 32, 0.8)


def test_jaccard_join_of_edge_cases(spark):
    assert rows_of(jaccard_join(clashing(documents(spark)))) == plain_classes(TEXTS)
    assert jaccard_join(documents(spark, [])).count() == 0


def test_jaccard_join_against_all_pairs(spark):
    draw = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randint(6, 160))]
        for _ in range(draw.randint(1, 14)):
            text = list(base)
            for _ in range(draw.randint(0, 5)):
                text[draw.randrange(len(text))] = f"w{draw.randrange(400)}"
            rows.append((len(rows), " ".join(text)))
    assert rows_of(jaccard_join(documents(spark, rows))) == plain_classes(rows)
    kept = keep_one(documents(spark, rows), jaccard_join(documents(spark, rows)))
    assert kept.count() == len({r[1] for r in plain_classes(rows)})


def test_blocks_count_each_pair_once():
    draw = np.random.default_rng(3)
    base = np.arange(1000, 1100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(100) < 0.95], draw.integers(0, 900, 3).astype(np.uint64)])) for _ in range(300)]
    forest = Forest(8, 2)
    prefixes = np.stack([forest.prefixes(s) for s in sets])
    weights = draw.integers(1, 4, len(sets))
    weight, root = links_of_block(0, None, weights, prefixes, sets, 0.8)
    held = [set(s.tolist()) for s in sets]
    want = [sum(weights[b] for b in range(len(sets)) if b != a and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])) for a in range(len(sets))]
    assert weight.tolist() == want
    assert {root[a] for a in range(len(sets)) if want[a]} == {0} or len(set(root.tolist())) < len(sets)
    # Split into homes, the pairs across and within homes add up to all pairs.
    homes = np.arange(len(sets)) % 2
    total, _ = links_of_block(0, homes, weights, prefixes, sets, 0.8)
    for home in (0, 1):
        own = np.flatnonzero(homes == home)
        inner, _ = links_of_block(0, None, weights[own], prefixes[own], [sets[k] for k in own], 0.8)
        total[own] += inner
    assert total.tolist() == want


# ---- line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_line_dedup(docs):
    """docs: unique ids and texts, no nulls."""
    first, trim = {}, " \t\r\f\x0b"
    norm = lambda line: ascii_lower(line).strip(trim)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if norm(line):
                first[norm(line)] = min(i, first.get(norm(line), i))
    rank = {k: (i, hashlib.md5(k.encode()).digest()) for k, i in first.items()}
    near = set()
    for a in first:
        for b in first:
            shorter = min(len(a), len(b))
            if rank[a] < rank[b] and shorter >= 25 and abs(len(a) - len(b)) <= 2:
                if edit_distance(a, b) <= min(2, shorter // 25):
                    near.add(b)
    out = []
    for i, t in docs:
        kept, seen, lines = [], set(), (t or "").split("\n")
        for line in lines:
            key = norm(line)
            if not key or (first[key] == i and key not in near and key not in seen):
                kept.append(line)
            seen.add(key)
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(lines), 0 if t is None else len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_bit_parallel_distance(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(400):
        a = [draw.choice("abé😀") for _ in range(draw.randint(25, 60))]
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(b))
            b[i : i + draw.randint(0, 1)] = draw.choice(["", "a", "b"])
        a, b = sorted(["".join(a), "".join(b)], key=len, reverse=True)
        if len(a) - len(b) <= 2:
            rows.append((a, b, edit_distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for edits in (1, 2):
        wrong = df.where(within_edits(F.col("a"), F.col("b"), F.lit(edits)) != (F.col("d") <= edits))
        assert wrong.count() == 0


def test_segments_cover_a_line_and_places_are_complete(spark):
    for edits in (1, 2):
        parts = segments(F.col("n"), edits)
        ends = spark.range(25, 200).select(F.col("id").cast("int").alias("n")).select(
            "n", *[c.alias(f"c{k}") for k, c in enumerate(c for p in parts for c in p)]
        )
        for row in ends.collect():
            at = 1
            for i in range(edits + 1):
                assert row[1 + 2 * i] == at
                at += row[2 + 2 * i]
            assert at == row.n + 1
    assert places(2, 0, 1) == [-1, 0, 1] and places(2, 1, 1) == [0, 1] and places(2, 2, 2) == [2]
    assert spark.range(1).select(allowed(F.lit(24)), allowed(F.lit(49)), allowed(F.lit(500))).first()[:] == (0, 1, 2)


def test_line_dedup_against_all_pairs(spark):
    draw = random.Random(9)
    bases = ["".join(draw.choice("abcde é") for _ in range(draw.randint(1, 90))) for _ in range(25)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(draw.randint(1, 8)):
            line = list(draw.choice(bases))
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                k = draw.randrange(len(line)) if line else 0
                line[k : k + draw.randint(0, 1)] = draw.choice(["", "x", "A"])
            lines.append("".join(line) + draw.choice(["", " ", "\r"]))
        docs.append((i, "\n".join(lines)))
    docs += [(30, None), (31, ""), (32, "\n\n")]
    found = line_dedup(clashing(documents(spark, docs))).select("doc_id", "text", "n_lines", "n_removed")
    assert rows_of(found) == plain_line_dedup(docs)


def test_line_dedup_of_edge_cases(spark):
    found = rows_of(line_dedup(documents(spark)).select("doc_id", "text", "n_lines", "n_removed"))
    assert len(found) == len(TEXTS)
    same = [r for r in found if r[0] in (1, 2, 7, None) and r[2]]
    assert [(r[0], r[3]) for r in sorted(same, key=lambda r: (r[0] is None, r[0] or 0))] == [(1, 0), (2, 1), (7, 1), (7, 1), (None, 1)]
    assert (3, None, 0, 0) in found and (4, "", 1, 0) in found
    assert line_dedup(documents(spark, [])).count() == 0
    twice = documents(spark, [(1, "same line\nsame line\nother"), (1, "same line\nsame line\nother")])
    assert [r.text for r in line_dedup(twice).collect()] == ["same line\nother"] * 2


def edited(draw, base, times):
    line = list(base)
    for _ in range(times):
        k = draw.randrange(len(line))
        line[k : k + draw.randint(0, 1)] = draw.choice(["", "x", "y"])
    return "".join(line)


def test_finer_keys_part_a_large_group_and_lose_no_near_line(spark):
    draw = random.Random(3)
    base = "".join(draw.choice("abcde ") for _ in range(90))
    short = base[:40]
    lines = sorted({edited(draw, b, times).strip() for b in (base, short) for times in (0, 1, 2, 2, 2) for _ in range(12)})
    table = spark.createDataFrame([(x, 0, 0, x, len(x)) for x in lines], "digest string, first_doc int, bits int, line string, n int")

    def linked(entries, name):
        x = entries.select("key", F.col("own").alias("x_own"), F.col(name).alias("x"))
        both = entries.join(x, "key").where((F.col("own") | F.col("x_own")) & (F.col(name) < F.col("x")))
        return {(r[0], r.x) for r in both.select(name, "x").distinct().collect()}

    def near(a, b):
        shorter = min(len(a), len(b))
        return abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= min(2, shorter // 25)

    want = {(a, b) for a in lines for b in lines if a < b and near(a, b)}
    coarse = linked(entries_of(table.select("line", "n")), "h")
    assert len(want) > 50
    for pieces in (5, 9):
        found = linked(finer_entries(table, pieces), "digest")
        assert want <= found
    bits = table.select("digest", line_dedups.sketch(F.col("line"), "").alias("bits")).collect()
    bits = {r.digest: r.bits & (2**64 - 1) for r in bits}
    assert all((bits[a] ^ bits[b]).bit_count() <= 4 for a, b in want)
    assert len(found) - len(want) < 0.4 * (len(coarse) - len(want))


def test_line_dedup_of_a_large_group_of_near_copies(spark, monkeypatch):
    draw = random.Random(4)
    base = "".join(draw.choice("abcde é") for _ in range(60))
    docs = [(i, edited(draw, base, 2) + "\n" + edited(draw, base[:30], 1)) for i in range(60)]
    docs += [(60 + i, edited(draw, draw.choice(docs)[1], 2)) for i in range(20)]
    monkeypatch.setattr(line_dedups, "KEY_LINES", 3)
    found = line_dedup(documents(spark, docs)).select("doc_id", "text", "n_lines", "n_removed")
    assert rows_of(found) == plain_line_dedup(docs)
