"""Benchmark decontamination: a broadcast set of hashed test windows, probed by every window of every document.

Only DataFrame functions are used. Inside its row, every window of a document is first tested by the hash of its
leading words against a bitmap of those of the test windows. The windows that pass are exploded with their words and
joined with the broadcast set on the words themselves, so a hit is exact and no document text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_WORD, WORD, numbered, stored, table, unused, words

WINDOW = 13
#: A window takes some 200 bytes; a set of more than this is joined by shuffle instead of broadcast.
MAX_BROADCAST_WINDOWS = 1_000_000
HEAD_WORDS = 3
PROBE = "array<struct<start:int,length:int,run:string>>"


def head_hash(terms: Column, start: Column, head: int) -> Column:
    """Hash of the leading words of a window; reads single elements, as slicing copies the whole array first."""
    return F.xxhash64(*[F.get(terms, start + j) for j in range(head)])


def bitmap(known: DataFrame, head: int, n_windows: int) -> tuple[Column, int]:
    """Bits of the head hashes of at most ``MAX_BROADCAST_WINDOWS`` windows as a constant array, and its bit count."""
    hashes = known.select(head_hash(F.col("words"), F.lit(0), head).alias("h")).distinct().collect()
    size = 1 << max(12, min(24, (64 * n_windows).bit_length()))
    cells = [0] * (size >> 6)
    for (h,) in hashes:
        cells[(h & (size - 1)) >> 6] |= 1 << (h & 63)
    text = ",".join(str(c - (1 << 64) if c >> 63 else c) for c in cells)
    return F.split(F.lit(text), ",").cast("array<bigint>"), size


def probes(terms: Column, lengths: list[int], head: int, bits: Column | None, size: int) -> Column:
    """(start, length, run) of every window whose head may be known."""
    count = F.size(terms)
    starts = F.sequence(F.lit(0), count - min(lengths))
    if bits is not None:

        def may_be_known(i: Column) -> Column:
            h = head_hash(terms, i, head)
            cell = F.get(bits, F.shiftright(h.bitwiseAND(F.lit(size - 1)), 6).cast("int"))
            return F.getbit(cell, h.bitwiseAND(F.lit(63)).cast("int")) == 1

        starts = F.filter(starts, may_be_known)

    def windows(length: int) -> Column:
        fitting = F.filter(starts, lambda i: i + length <= count) if len(lengths) > 1 else starts

        def run(i: Column) -> Column:
            return F.concat_ws(" ", *[F.get(terms, i + j) for j in range(length)])

        return F.transform(
            fitting, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), run(i).alias("run"))
        )

    found = F.concat(*[windows(n) for n in lengths])
    return F.when(count >= min(lengths), found).otherwise(F.array().cast(PROBE))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows (words, length, known: the words as text) with the ids of the items they come from."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("terms")
    ).where(F.size("terms") > 0)
    items = items.withColumn("length", F.least(F.size("terms"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("terms") - F.col("length") + 1)
    slices = F.transform(starts, lambda i: F.slice("terms", i, F.col("length")))
    runs = items.select("item", "length", F.explode(slices).alias("words"))
    found = runs.groupBy("words", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return found.withColumn("known", F.array_join("words", " "))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items, runs, contaminated.

    A window is ``window`` consecutive words of an item, or the whole of an item with fewer. Words inside any
    occurrence of a window are hit; ``runs`` has each occurrence as start and end (exclusive) in words, ``items`` the
    sorted ids of the items they come from. A document is contaminated if at least a twentieth of its words are hit.
    Null and empty texts have no words and no hits, items without words no windows. A null item id counts as the
    empty string, items of equal id are one. Rows of equal or null doc_id stay rows of their own. An empty table of
    documents gives an empty result, an empty benchmark one without hits.
    """
    found = stored(benchmark_windows(benchmark, item_col, item_text_col, window))
    sizes = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most ``window`` rows
    known, n_windows = found.select("known", "items"), sum(sizes.values())
    terms, lengths, bits, size = F.col("terms"), sorted(sizes), None, 0
    head = min([HEAD_WORDS, *lengths])
    if n_windows <= MAX_BROADCAST_WINDOWS:
        known = F.broadcast(known)
        bits, size = bitmap(found, head, n_windows)

    first = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("run")))
    tried = F.concat(first.cast(PROBE), probes(terms, lengths, head, bits, size)) if lengths else first.cast(PROBE)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        words(F.col(text_col)).alias("terms"),
        F.monotonically_increasing_id().alias("row"),
    )
    windows = rows.select("row", "doc_id", F.size("terms").alias("n_words"), F.inline(tried))
    matched = windows.join(known, F.col("run") == F.col("known"), "left")
    hits = matched.where((F.col("start") < 0) | F.col("known").isNotNull()).select(
        "row",
        "doc_id",
        "n_words",
        F.when(F.col("start") >= 0, F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("run"),
        "items",
    )
    by_row = hits.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("run")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, r: F.struct(
            (a.n + F.greatest(F.lit(0), r.end - F.greatest(r.start, a.upto))).alias("n"),
            F.greatest(a.upto, r.end).alias("upto"),
        ),
        lambda a: a.n.cast("long"),
    )
    report = by_row.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "runs"
    )
    return report.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, report: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is not that of a contaminated one, all columns unchanged."""
    name = unused(docs, "bad_id")
    bad = report.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad[name]), "left_anti")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows that are not contaminated, all columns unchanged. Every row is judged by itself, whatever its id."""
    rows, row = numbered(docs)
    bad = contamination(rows, benchmark, id_col=row, **settings).where("contaminated").select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def drop_spans(docs: DataFrame, report: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their hit words (each goes with the separators after it). Ids must be unique."""
    own_id, own_runs = unused(docs, "own_id"), unused(docs, "own_runs")
    runs = report.where("n_hit > 0").select(F.col("doc_id").alias(own_id), F.col("runs").alias(own_runs))
    joined = docs.join(runs, docs[id_col].cast("long").eqNullSafe(runs[own_id]), "left")
    text = F.col(text_col)
    spare = NO_WORD.removesuffix("+")
    lead = F.regexp_extract(text, f"^({spare}*)", 1)
    pieces = F.regexp_extract_all(text, F.lit(f"({WORD}{spare}*)"), 1)
    left = F.filter(pieces, lambda _, i: ~F.exists(own_runs, lambda r: (r.start <= i) & (i < r.end)))
    cut = F.when(F.col(own_runs).isNull(), text).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.withColumn(text_col, cut).select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


DECONTAMINATE_SQL = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
known AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
probes AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM terms, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, known.n FROM probes JOIN known USING (run, n)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
SELECT doc_id,
       CAST(coalesce(len(w), 0) AS BIGINT) AS n_words,
       coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM terms LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
