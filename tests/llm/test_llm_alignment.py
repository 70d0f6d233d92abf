import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from cases import TEXTS, clashing, documents, rows_of
from gablework.llm.packing import public_tokenizer
from gablework.llm.token_alignment import TOKENIZER_A, TOKENIZER_B, Pair, align, op11_token_alignment

MIXED = list("ab e1.'-\n\t \r\x0b\x1cé日😀▁<>s　,;{}()") + ["<s>", "</s>", "<|endoftext|>", "the ", "  ", "'s", "\n\n", "ing", "aaaa"]


@pytest.fixture(scope="module")
def pair():
    return Pair(public_tokenizer(TOKENIZER_A), public_tokenizer(TOKENIZER_B))


def spans(parts):
    at, out = 0, []
    for part in parts:
        out.append((at, at + len(part)))
        at += len(part)
    return out


def plain(pair, rows):
    """The contract read literally: whole texts, all pairs of overlapping tokens one by one."""
    counts, links, out = Counter(), [], []
    for doc_id, text in rows:
        a, b = [], []
        if text:
            a, b = pair.encode_a([" " + text])[0], pair.b.encode(text)
            if any(b"".join(by[i] for i in x) != (" " + text).encode() for by, x in ((pair.bytes_a, a), (pair.bytes_b, b))):
                a, b = [], []
        at_a, at_b = spans([pair.bytes_a[i] for i in a]), spans([pair.bytes_b[i] for i in b])
        found, start = [], 0
        for i, (s, e) in enumerate(at_a):
            while start < len(at_b) and at_b[start][1] <= s:
                start += 1
            j = start
            while j < len(at_b) and at_b[j][0] < e:
                found.append((a[i], b[j]))
                j += 1
        counts.update(found)
        links.append(found)
        groups = []
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            low = groups[-1][0] if groups else 0
            sides = [",".join(str(t) for t, (s, e) in zip(ids, at) if low <= s and e <= end) for ids, at in ((a, at_a), (b, at_b))] if len(text) < 3000 else None
            groups.append((end, sides))
        known = all(g[1] for g in groups)
        digest = hashlib.sha256(";".join("|".join(g[1]) for g in groups).encode()).hexdigest() if groups and known else "" if not groups else None
        out.append((doc_id, len(a), len(b), len(groups), len(found), digest))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (*row[:5], sum(counts[p] == most[p[1]] for p in found), sum(counts[p] for p in found), row[5]) for row, found in zip(out, links)
    ], counts


def held(df):
    return rows_of(df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def same(found, expected):
    short = [r[-1] is not None for r in sorted(expected, key=repr)]
    assert len(found) == len(expected)
    left, right = sorted(found, key=lambda r: repr(r[:-1])), sorted(expected, key=lambda r: repr(r[:-1]))
    assert [r[:-1] for r in left] == [r[:-1] for r in right]
    assert any(short)
    assert Counter(r[-1] for r in right if r[-1] is not None) <= Counter(r[-1] for r in left)


@pytest.mark.parametrize("block_bytes", [200, 4 << 20])
def test_documents_and_pairs_match_plain_python(spark, pair, block_bytes):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice(MIXED) for _ in range(draw.randint(0, 40)))) for i in range(400)]
    rows += TEXTS
    expected, counts = plain(pair, rows)
    found = align(clashing(documents(spark, rows)), block_bytes=block_bytes)
    same(held(found.documents), expected)
    assert {(r.a, r.b): r.n for r in found.pairs.collect()} == dict(counts)


def test_whole_table_matches_plain_python(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected, _ = plain(pair, [(r.doc_id, r.text) for r in docs.collect()])
    same(held(op11_token_alignment(spark, "/root/testdata/sf0.001")), expected)


def test_groups_of_a_known_text(pair):
    rows, _ = plain(pair, [(1, "a b")])
    a, b = pair.encode_a([" a b"])[0], pair.b.encode("a b")
    assert rows[0][-1] == hashlib.sha256(f"{a[0]}|{b[0]};{a[1]}|{b[1]}".encode()).hexdigest()


def test_ids_of_the_same_bytes(pair):
    a = pair.encode_a([" the"])[0]
    assert len(a) == 1 and pair.bytes_b[pair.same[a[0]]] == b" the"
    assert all(pair.bytes_a[i] == pair.bytes_b[j] for i, j in enumerate(pair.same.tolist()) if j >= 0)


def test_empty_table(spark):
    found = align(documents(spark).limit(0))
    assert found.documents.count() == 0 and found.pairs.count() == 0
