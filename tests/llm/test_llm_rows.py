"""The pipeline's filters judge rows: ids may be null or repeated. Held against plain Python."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from cases import LONG, clashing, documents
from gablework.llm.decontaminate import uncontaminated
from gablework.llm.jaccard_join import near_unique
from gablework.llm.terms import words_of

STORY = "a quiet river runs past the old mill and on through the green valley to the wide grey sea beyond the last low hills of home"
OTHER = "nothing of the sort was ever said by any of them in the long dark winter when the snow lay deep upon every roof in town"


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def sets(text):
    w = words_of(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def plain_unique(rows):
    """Classes by comparing all pairs; of each the row of least id, null last, stays."""
    shingled = [sets(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if shingled[i] and shingled[j] and 5 * len(shingled[i] & shingled[j]) >= 4 * len(shingled[i] | shingled[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        key = (doc_id is None, doc_id or 0, i)
        best[label[i]] = min(best.get(label[i], key), key)
    return sorted((rows[k[2]] for k in best.values()), key=lambda r: repr(r))


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    near = STORY.replace("grey", "blue") + " " + STORY  # unlike the others: longer
    rows = [(None, STORY), (None, STORY), (5, OTHER), (5, OTHER), (9, OTHER), (9, near), (7, None), (7, None), (None, ""), (3, LONG), (3, LONG)]
    found = kept_rows(near_unique(clashing(documents(spark, rows))))
    expected = plain_unique(rows)
    assert [r[1] for r in found] == [r[1] for r in sorted(expected, key=repr)] and [r[0] for r in found] == [r[0] for r in sorted(expected, key=repr)]
    assert (9, near) in found and (9, OTHER) not in found and found.count((5, OTHER)) == 1


def test_random_near_copies(spark):
    draw = random.Random(3)
    base = [[f"w{draw.randint(0, 30)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(80):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 3])):
            words[draw.randrange(60)] = f"n{draw.randint(0, 9)}"
        rows.append((draw.choice([None, 1, 2, 3, i]), " ".join(words)))
    found, expected = kept_rows(near_unique(documents(spark, rows))), plain_unique(rows)
    # Rows that share the least id of a class may stand in for each other, so ids are compared.
    assert len(found) == len(expected)
    assert sorted(map(repr, (r[0] for r in found))) == sorted(map(repr, (r[0] for r in expected)))


def test_contaminated_rows_go_alone(spark):
    passage = " ".join(STORY.split()[:16])
    benchmark = spark.createDataFrame([("b1", passage)], "item_id string, text string")
    rows = [(9, f"start {passage} end"), (9, OTHER), (None, passage), (None, OTHER), (4, None), (4, ""), (6, STORY + " " + " ".join(f"x{i}" for i in range(600)))]
    found = kept_rows(uncontaminated(clashing(documents(spark, rows)), benchmark))
    assert found == sorted([(9, OTHER), (None, OTHER), (4, None), (4, ""), rows[-1]], key=repr)


def test_empty_tables(spark):
    empty = documents(spark).limit(0)
    benchmark = spark.createDataFrame([("b1", STORY)], "item_id string, text string")
    assert near_unique(empty).count() == 0 and uncontaminated(empty, benchmark).count() == 0
    assert uncontaminated(documents(spark), benchmark.limit(0)).count() == documents(spark).count()
