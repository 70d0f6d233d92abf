"""Line dedup across documents, with a segment-partition edit join for near copies of lines.

Only DataFrame functions are used. Lines are equal after lower-casing A-Z and trimming blanks. Two different lines
are near if their edit distance is at most one per ``CHARS_PER_EDIT`` characters of the shorter, ``MAX_EDITS`` at
most. Such a line is cut into threshold-plus-one even segments; at least one of them must occur unchanged in a near
line, at one of a few places that its length allows. Segments and the substrings at these places are hashed with
length and number into one index key. Keys that only one line has are dropped after one narrow shuffle; what is left
is filtered by a bit sketch and verified by edit distance. Lines of keys that many share are compared with the key's
leading line, and then by keys that hold all of a line but the segments with the edits, of ever more segments.

Documents are ordered by id. A line stays where it occurs first, unless it is near a different line that precedes
it (by first document, then by digest); all other occurrences go. Blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ascii_lower, stored, table, unused

CHARS_PER_EDIT, MAX_EDITS = 25, 2
BLANKS = " \t\r\f\x0b"
#: Places of candidate lines broadcast to fetch their texts, 50 bytes each; beyond this they are joined by shuffle.
MAX_BROADCAST_LINES = 500_000
#: Lines that are at least this fraction (1 / HOT_LINES) of all lines are handled by broadcast.
HOT_LINES = 1000
#: Keys with more lines than this are replaced by keys of all but the edited ones of so many segments, step by step.
KEY_LINES, FINER_PIECES = 32, (5, 9)
LAST = 2**63 - 1


def allowed(length: Column) -> Column:
    return F.least(F.lit(MAX_EDITS), F.floor(length / CHARS_PER_EDIT).cast("int"))


def segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of the ``edits`` + 1 even segments of a line; longer segments come last."""
    short = edits + 1 - F.pmod(length, F.lit(edits + 1))
    base = ((length - F.pmod(length, F.lit(edits + 1))) / (edits + 1)).cast("int")
    return [
        (1 + i * base + F.greatest(F.lit(0), i - short), base + F.when(F.lit(i) >= short, 1).otherwise(0))
        for i in range(edits + 1)
    ]


def places(edits: int, longer_by: int, i: int) -> list[int]:
    """Shifts at which segment ``i`` of a line may begin in a near line that is ``longer_by`` characters longer.

    Before a segment matched first, at most i edits were made, and after it at most edits - i.
    """
    rest = edits - i
    return list(range(max(-i, longer_by - rest), min(i, longer_by + rest) + 1))


def entries_of(lines: DataFrame) -> DataFrame:
    """(key, h, own) of lines (line, n): keys of their own segments (own), and of the places to probe for lines that
    are as long or shorter."""
    cuts = {}
    for longer_by in range(MAX_EDITS + 1):
        for edits in range(max(1, longer_by), MAX_EDITS + 1):
            for i, (start, width) in enumerate(segments(F.col("n") - longer_by, edits)):
                cuts[f"start_{longer_by}_{edits}_{i}"], cuts[f"width_{longer_by}_{edits}_{i}"] = start, width

    def keys(longer_by: int, edits: int, own: bool) -> list[Column]:
        return [
            F.xxhash64(
                F.col("n") - longer_by,
                F.lit(i),
                F.substring(
                    F.col("line"), F.col(f"start_{longer_by}_{edits}_{i}") + shift, F.col(f"width_{longer_by}_{edits}_{i}")
                ),
            )
            for i in range(edits + 1)
            for shift in places(edits, longer_by, i)
            if own == (longer_by == 0 and shift == 0)
        ]

    def all_keys(edits_by_longer: list[int]) -> Column:
        """Own keys first; ``edits_by_longer`` has the edits allowed with a line that is 0, 1, .. characters shorter."""
        listed = keys(0, edits_by_longer[0], True)
        for longer_by, edits in enumerate(edits_by_longer):
            listed += keys(longer_by, edits, False) if edits >= max(1, longer_by) else []
        return F.array(*listed)

    # The edits allowed with shorter lines change only within MAX_EDITS characters above a multiple.
    cases = F.lit(None).cast("array<bigint>")
    for edits in range(1, MAX_EDITS + 1):
        for above in range(MAX_EDITS + 1):
            known = [edits if longer_by <= above else edits - 1 for longer_by in range(MAX_EDITS + 1)]
            cases = F.when(F.col("n") >= edits * CHARS_PER_EDIT + above, all_keys(known)).otherwise(cases)
    listed = lines.select("line", "n", *[c.alias(name) for name, c in cuts.items()])
    listed = listed.select(F.xxhash64("line").alias("h"), allowed(F.col("n")).alias("edits"), F.posexplode(cases).alias("at", "key"))
    return listed.select("key", "h", (F.col("at") <= F.col("edits")).alias("own"))


def finer_entries(lines: DataFrame, pieces: int) -> DataFrame:
    """Entries of lines by all of a line but one segment of ``pieces``, or two where two edits are allowed.

    Those are the segments that the edits lie in. What precedes them stands unmoved in a near line, what follows them is
    moved by the difference in length, and what lies between two of them by one place at most. Edits in one segment
    only are covered by two neighbouring ones, which have nothing between them.
    """
    cases = []
    for edits in range(1, MAX_EDITS + 1):
        for longer_by in range(edits + 1):
            for a in range(pieces):
                for b in [a] if edits == 1 else range(a + 1, pieces):
                    moved = [0] if b <= a + 1 else [m for m in (-1, 0, 1) if abs(longer_by - m) <= 1]
                    cases += [(edits, longer_by, a, b, m) for m in moved]
    names = ("edits", "longer_by", "a", "b", "moved")
    listed = F.array(*[F.struct(*[F.lit(v).alias(name) for name, v in zip(names, case)]) for case in cases])
    n = F.char_length("line")

    def ends(c: Column, i: Column) -> Column:
        """Characters before segment i."""
        length = n - c.longer_by
        over = F.pmod(length, F.lit(pieces))
        return i * ((length - over) / pieces).cast("int") + F.greatest(F.lit(0), i - pieces + over)

    def entry(c: Column) -> Column:
        first, last = ends(c, c.a + 1), ends(c, c.b)
        key = F.xxhash64(
            n - c.longer_by, c.a, c.b, F.substring(F.col("line"), F.lit(1), ends(c, c.a)),
            F.substring(F.col("line"), first + 1 + c.moved, F.greatest(F.lit(0), last - first)),
            F.substring(F.col("line"), ends(c, c.b + 1) + 1 + c.longer_by, n),
        )
        return F.struct(key.alias("key"), ((c.longer_by == 0) & (c.moved == 0)).alias("own"))

    fitting = F.filter(listed, lambda c: c.edits == allowed(n - c.longer_by))
    sketched = lines.select("digest", "first_doc", "bits", sketch(F.col("line"), "").alias("letters"), "line")
    entries = sketched.select("digest", "first_doc", "bits", "letters", F.explode(F.transform(fitting, entry)).alias("e"))
    return entries.select("e.key", "e.own", "digest", "first_doc", "bits", "letters")


def sketch(line: Column, between: str = " ") -> Column:
    """64 parities of the hashed words of a line; one edit flips at most three of them (it may join two words). With
    nothing between them, of its characters; one edit flips at most two."""
    return F.aggregate(
        F.split(line, between),
        F.lit(0).cast("long"),
        lambda bits, word: bits.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(word), F.lit(64)))
        ),
    )


def within_edits(longer: Column, shorter: Column, edits: Column) -> Column:
    """Whether the edit distance of two lines is at most ``edits`` (at most MAX_EDITS)."""
    return F.levenshtein(longer, shorter, MAX_EDITS).between(F.lit(0), edits)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, line) of every line that is not blank, in normal form."""
    pieces = F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line")
    rows = docs.select("doc_id", "text_hash", pieces)
    return rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def near_lines(placed: DataFrame, lines: DataFrame, hot: DataFrame) -> DataFrame:
    """Digests of the lines that are near a different line that precedes them.

    placed: every occurrence; lines: the distinct lines; hot: those so frequent that one occurrence stands for all.
    """
    once = F.broadcast(hot.select("digest", F.col("place").alias("only")))
    every = placed.select("digest", "place", "line", F.char_length("line").alias("n")).where(F.col("n") >= CHARS_PER_EDIT)
    some = every.join(once, "digest", "left").where(F.col("only").isNull() | (F.col("only") == F.col("place")))
    entries = entries_of(some.select("line", "n"))
    by_key = Window.partitionBy("key")
    shared = entries.repartition("key").select(
        "key", "h", "own", F.min("h").over(by_key).alias("least"), F.max("h").over(by_key).alias("most"),
        F.max("own").over(by_key).alias("indexed"),
    )
    shared = stored(shared.where("least < most and indexed").select("key", "h", "own").distinct())

    wanted = stored(lines.join(shared.select("h").distinct(), "h").select("digest", "h", "first_doc", "place"))
    at = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_LINES else wanted
    texts = placed.select("place", "line").join(at, "place").withColumn("bits", sketch(F.col("line"))).drop("place")
    texts = stored(texts)
    entries = stored(shared.join(texts.select("h", "digest", "first_doc", "bits"), "h").drop("h").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (before, after) pairs of digests those that are near."""
        pairs = pairs.distinct()
        before = texts.select(F.col("digest").alias("before"), F.col("line").alias("x"))
        after = texts.select(F.col("digest").alias("after"), F.col("line").alias("y"))
        both = pairs.join(before, "before").join(after, "after")
        swap = F.char_length("x") < F.char_length("y")
        both = both.select(
            "after",
            F.when(swap, F.col("y")).otherwise(F.col("x")).alias("longer"),
            F.when(swap, F.col("x")).otherwise(F.col("y")).alias("shorter"),
        )
        edits = allowed(F.char_length("shorter"))
        fits = F.char_length("longer") - F.char_length("shorter") <= edits
        near = F.when(fits, within_edits(F.col("longer"), F.col("shorter"), edits)).otherwise(False)
        return both.where(near).select(F.col("after").alias("digest")).distinct()

    order = F.struct("first_doc", "digest")
    found = None
    for pieces in [*FINER_PIECES, None]:
        # First every line against the leading line of its key, which settles most of a large group in one pass.
        leading = entries.where("own").groupBy("key").agg(F.min(order).alias("lead"))
        left = entries if found is None else entries.join(found, "digest", "left_anti")
        led = left.join(leading, "key").where(order > F.col("lead"))
        settled = verified(led.select(F.col("lead.digest").alias("before"), F.col("digest").alias("after")))
        found = stored(settled if found is None else found.unionByName(settled))
        left, x = entries.join(found, "digest", "left_anti"), entries
        # Large groups that it leaves open are cut again by finer keys, as their pairs grow with the square of their size.
        large = None
        if pieces is not None:
            sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > KEY_LINES)
            large = stored(sizes.join(left.select("key"), "key", "left_semi").select("key"))
            large = None if large.isEmpty() else large
        if large is not None:
            left, x = (part.join(large, "key", "left_anti") for part in (left, x))
        x = x.select("key", *[F.col(c).alias(f"x_{c}") for c in x.columns if c != "key"])
        alike = F.bit_count(F.col("bits").bitwiseXOR(F.col("x_bits"))) <= 3 * MAX_EDITS
        if "letters" in entries.columns:
            alike = alike & (F.bit_count(F.col("letters").bitwiseXOR(F.col("x_letters"))) <= 2 * MAX_EDITS)
        pairs = left.join(x, "key").where(
            (F.col("own") | F.col("x_own"))
            & (F.struct("x_first_doc", "x_digest") < order)
            & alike
        )
        rest = verified(pairs.select(F.col("x_digest").alias("before"), F.col("digest").alias("after")))
        if large is None:
            return found.unionByName(rest).distinct()
        found = stored(found.unionByName(rest))
        again = entries.join(large, "key", "left_semi").select("digest").distinct()
        entries = stored(finer_entries(texts.join(again, "digest"), pieces))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input rows and columns with the text cut, and the columns n_lines, n_removed (long).

    A null text stays null and has no lines; an empty text is one blank line. Documents with a null id come last in
    the order, rows of equal id and text lose the same lines, rows of equal id only are separate documents of one
    rank. Lines of any length take part; those below ``CHARS_PER_EDIT`` characters match only equal lines. An empty
    table gives an empty result. The two added columns replace input columns of the same name.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = plain.withColumn("text_hash", F.xxhash64("text"))
    found = line_table(plain).select(
        "doc_id",
        "text_hash",
        "pos",
        F.coalesce("doc_id", F.lit(LAST)).alias("rank"),
        digest(F.col("line")).alias("digest"),
        F.xxhash64("line").alias("h"),
        F.monotonically_increasing_id().alias("place"),
        "line",
    )
    placed = stored(found, "zstd")
    lines = placed.groupBy("digest").agg(
        F.min("rank").alias("first_doc"),
        F.min_by("place", "rank").alias("place"),
        F.min("h").alias("h"),
        F.count(F.lit(1)).alias("n"),
    )
    lines = stored(lines)
    hot = stored(lines.where(F.col("n") * HOT_LINES >= max(placed.count(), HOT_LINES)))
    near = near_lines(placed, lines, hot).withColumn("near", F.lit(True))
    several = stored(
        lines.where("n > 1").join(near, "digest", "left").select("digest", "first_doc", "near")
        .unionByName(lines.where("n = 1").join(near, "digest").select("digest", "first_doc", "near"))
    )
    own = Window.partitionBy("doc_id", "text_hash", "digest")
    places_of = placed.drop("line").withColumn("kept", F.min("pos").over(own)).drop("h", "place")
    often = F.broadcast(several.join(F.broadcast(hot.select("digest")), "digest", "left_semi"))
    seldom = several.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    not_hot = places_of.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    judged = places_of.join(often, "digest").unionByName(not_hot.join(seldom, "digest"))
    gone = judged.where(
        F.coalesce("near", F.lit(False)) | (F.col("rank") > F.col("first_doc")) | (F.col("pos") > F.col("kept"))
    )
    own_id, own_hash, places_gone = (unused(docs, n) for n in ("own_id", "own_hash", "places_gone"))
    gone = gone.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(
        F.collect_set("pos").alias(places_gone)
    )
    same = docs[id_col].cast("long").eqNullSafe(gone[own_id]) & (F.xxhash64(docs[text_col]) == gone[own_hash])
    all_lines = F.split(F.col(text_col), "\n")
    ends = F.octet_length(F.col(text_col)) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    left = F.array_except(F.sequence(F.lit(0), ends), F.col(places_gone))
    # A lambda computes its body for each element, so the split is an array of one that an outer lambda takes.
    cut = F.get(
        F.transform(F.array(all_lines), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")), F.lit(0)
    )
    joined = docs.join(gone, same, "left")
    return joined.select(
        *[
            F.when(F.col(places_gone).isNull(), F.col(c)).otherwise(cut).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
            if c not in ("n_lines", "n_removed")
        ],
        F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(places_gone), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


LINES_SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (
  SELECT doc_id, i AS pos, l[i] AS raw_line,
         trim(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM raw)),
kind AS (SELECT line, min(doc_id) AS first_doc, md5(line) AS digest, length(line) AS n
         FROM line WHERE line <> '' GROUP BY 1),
sized AS (SELECT *, least(2, n // 25) AS edits, n // 3 AS third FROM kind WHERE n >= 25),
pair AS (
  SELECT a.line AS x, b.line AS y
  FROM sized a JOIN sized b
    ON b.n BETWEEN a.n AND a.n + 2 AND b.n - a.n <= a.edits AND (a.n < b.n OR a.line < b.line)
   AND (contains(b.line, substr(a.line, 1, a.third)) OR contains(b.line, substr(a.line, a.third + 1, a.third))
        OR contains(b.line, substr(a.line, 2 * a.third + 1)))
   AND levenshtein(a.line, b.line) <= a.edits),
near AS (
  SELECT DISTINCT CASE WHEN (p.first_doc, p.digest) < (q.first_doc, q.digest) THEN q.line ELSE p.line END AS line
  FROM pair JOIN kind p ON p.line = x JOIN kind q ON q.line = y),
kept AS (
  SELECT doc_id, pos, raw_line,
         line = '' OR (doc_id = first_doc AND near.line IS NULL
                       AND pos = min(pos) OVER (PARTITION BY doc_id, line)) AS stays
  FROM line LEFT JOIN kind USING (line) LEFT JOIN near USING (line))
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(cut, '')) END AS text_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
         string_agg(raw_line, chr(10) ORDER BY pos) FILTER (stays) AS cut
  FROM kept GROUP BY 1) USING (doc_id)
"""
