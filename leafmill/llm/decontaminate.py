"""Benchmark decontamination by winnowing, in DataFrame functions alone.

The fingerprint of ten adjacent words is the least hash among their six 5-grams, so whichever ten words a document
shares with a benchmark item, both have the same fingerprint there; adjacent windows with one fingerprint are one.
Documents' fingerprints are joined with the benchmark's; each hit is extended to the (up to six) ten-word windows
that it stands for, and these are looked up among the benchmark's distinct windows, by 128 bits of hash. Items of under
ten words are windows of their own length; documents' places whose first word starts such an item are extended alike.

The benchmark's tables are broadcast only if their rows are counted and at most BROADCAST_ROWS, else joined by shuffle.
Documents' rows are dealt anew but once, as one row for each document and one for each hit. A document's own row goes
through the joins under a key of its own, which no benchmark row has, so all are spread evenly. Words that begin a
short item are looked for in the document's words at hand, where the distinct ones are at most FIRST_WORDS, so just
their places become rows.

Defined results: null and word-less texts have n_words 0 and are clean; a null or word-less item has no window.
Repeated rows of one id and text stay as many rows; rows of one id with different texts are judged apart. An empty
benchmark leaves all documents clean. Columns beside id and text are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, table

GRAM = 5
#: Rows of a benchmark table that may be broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000
#: Distinct first words of short items that are compared in place.
FIRST_WORDS = 1000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, an empty array for null."""
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def gram(words: Column, start: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(width)])


def window_key(words: Column, start: Column, width: int) -> Column:
    """128 bits that stand for `width` words from `start`."""
    at = [F.get(words, start + k) for k in range(width)]
    return F.struct(F.xxhash64(F.lit(width), *at).alias("k1"), F.xxhash64(*at[::-1], F.lit(width)).alias("k2"))


def upto(first: Column, last: Column) -> Column:
    """first..last, empty if last is less."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def with_winnowed(df: DataFrame, words: str, window: int) -> DataFrame:
    """Adds `least`: for each window of words the hash of its fingerprint, the least among its 5-grams.

    The sliding minimum is made by doubling. Each array is named twice by the next expression, so the optimizer keeps
    it as a column and does not compute it anew for each element.
    """
    n, span, reach = F.size(words), window - GRAM + 1, 1
    df = df.withColumn("least", F.transform(upto(F.lit(0), n - GRAM), lambda i: gram(F.col(words), i, GRAM)))
    while reach < span:
        step = min(reach, span - reach)
        left = F.greatest(F.size("least") - step, F.lit(0))
        df = df.withColumn("least", F.zip_with(F.slice("least", 1, left), F.slice("least", step + 1, left), lambda a, b: F.least(a, b)))
        reach += step
    return df


def runs(window: int) -> Column:
    """Windows to be looked up, of the column `least`: each where the fingerprint changes, standing for as many windows
    as a fingerprint can lie in; and each of those after, where the text repeats itself and a run goes on for longer."""
    span = window - GRAM + 1
    at = lambda i: F.get("least", i)
    return F.filter(upto(F.lit(0), F.size("least") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)) | ((i >= span) & (at(i) == at(i - span))))


def held(df: DataFrame) -> DataFrame:
    """df computed and counted; marked for broadcast if its rows are few enough."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, item_id: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: k1, k2, `of` (its word hashes) and the sorted items that have it."""
    w, n = F.col("words"), F.size("words")
    words = items.select(F.col(item_id).alias("item"), word_hashes(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    every = words.where(n >= window).select("item", F.explode(F.transform(F.sequence(F.lit(0), n - window), lambda i: F.struct(window_key(w, i, window).alias("key"), F.slice(w, i + 1, window).alias("of")))).alias("x"))
    for k in range(1, window):
        every = every.unionAll(words.where(n == k).select("item", F.struct(window_key(w, F.lit(0), k).alias("key"), w.alias("of")).alias("x")))
    keyed = every.select("x.key.k1", "x.key.k2", "x.of", "item")
    return checkpointed(keyed.groupBy("k1", "k2").agg(F.first("of").alias("of"), F.array_sort(F.collect_set(F.col("item"))).alias("items")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """id, text_hash, n_words, spans (sorted starts and widths of hits, in words), n_hit, items and contaminated, for each row."""
    windows = benchmark_windows(benchmark, item_id, item_text, window)
    keys = held(windows.select("k1", "k2", "items"))
    widths = sorted(r[0] for r in windows.select(F.size("of")).distinct().collect() if r[0] < window)
    full = with_winnowed(windows.where(F.size("of") == window).select("of"), "of", window)
    prints = full.select(F.get("least", F.lit(0)).alias("h"), F.lit(0).alias("short"))
    firsts = windows.where(F.size("of") < window).select(F.get("of", F.lit(0)).alias("h"), F.lit(1).alias("short"))
    begins = [r["h"] for r in firsts.select("h").distinct().limit(FIRST_WORDS + 1).collect()]
    prints = held(prints.unionAll(firsts).distinct().withColumn("met", F.lit(True)))

    w, n = F.col("words"), F.size("words")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), word_hashes(F.col(text_col)).alias("words"))
    base = with_winnowed(base, "words", window)
    # A row of the document itself (under a hash of its own, as kind 2), and a row for each fingerprint with the words
    # that it may be extended to.
    reach = 2 * window - GRAM
    rows = F.concat(
        F.array(F.struct(F.xxhash64("id", "text_hash").alias("h"), F.lit(2).alias("short"), n.alias("at"), F.array().cast("array<bigint>").alias("of"))),
        F.transform(runs(window), lambda i: F.struct(F.get("least", i).alias("h"), F.lit(0).alias("short"), i.alias("at"), F.slice(w, i + 1, reach).alias("of"))),
    )
    if widths:
        starts = upto(F.lit(0), n - 1)
        if len(begins) <= FIRST_WORDS:
            starts = F.filter(starts, lambda i: F.get(w, i).isin(begins))
        rows = F.concat(rows, F.transform(starts, lambda i: F.struct(
            F.get(w, i).alias("h"), F.lit(1).alias("short"), i.alias("at"), F.slice(w, i + 1, widths[-1]).alias("of"))))
    places = base.select("id", "text_hash", F.explode(rows).alias("r")).select("id", "text_hash", "r.*")
    met = places.join(prints, ["h", "short"], "left").where("short = 2 or met")

    of = F.col("of")
    tried = lambda i, k: F.struct(window_key(of, i, k).alias("key"), (F.col("at") + i).alias("start"), F.lit(k).alias("width"))
    itself = F.struct(F.struct(F.col("h").alias("k1"), F.xxhash64("h").alias("k2")).alias("key"), F.lit(0).alias("start"), F.lit(0).alias("width"))
    tries = F.when(F.col("short") == 2, F.array(itself))
    if widths:
        tries = tries.when(F.col("short") == 1, F.filter(F.array(*[tried(F.lit(0), k) for k in widths]), lambda x: x["width"] <= F.size(of)))
    tries = tries.otherwise(F.transform(upto(F.lit(0), F.size(of) - window), lambda i: tried(i, window)))
    windows_met = met.select("id", "text_hash", F.when(F.col("short") == 2, F.col("at")).alias("n_words"), F.explode(tries).alias("t"))
    flat = windows_met.select("id", "text_hash", "n_words", "t.key.k1", "t.key.k2", "t.start", "t.width")
    found = flat.join(keys, ["k1", "k2"], "left").withColumn("items", F.when(F.col("n_words").isNull(), F.col("items"))).where("n_words is not null or items is not null")
    each = found.groupBy("id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").cast("int").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "width")))).alias("spans"),
        F.collect_set("items").alias("sets"),
    )
    n_hit = covered(F.col("spans"))
    return each.select(
        F.col("id").alias(id_col), "text_hash", "n_words", n_hit.alias("n_hit"), "spans",
        F.array_sort(F.array_distinct(F.transform(F.flatten("sets"), lambda x: x.cast("string")))).alias("items"),
        (F.size("spans") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def covered(spans: Column) -> Column:
    """Words that sorted spans cover."""
    zero = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["until"], s["start"] + s["width"]).alias("until"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["width"] - F.greatest(a["until"], s["start"]))).alias("n")))["n"]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, width, array_to_string(w[i : i + width - 1], ' ') AS key
  FROM words, widths, unnest(generate_series(1, len(w) - width + 1)) AS s(i)),
met AS (SELECT d.doc_id, d.i, d.width, m.item_id FROM doc_windows d JOIN item_windows m USING (key, width)),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM met, unnest(generate_series(0, width - 1)) AS s(k) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
