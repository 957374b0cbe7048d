"""Personal data: patterns for the protected entities, and information-theoretic sanitisation of what reveals them.

All in DataFrame functions. Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Their
values are the protected entities, and all words of the texts that hold one are terms that may reveal it. From the
whole corpus, P(entity | term) is estimated as the texts with both over the texts with the term, P(entity) as the
entity's texts over all; the term's pointwise mutual information with the entity, over the entity's own information,
is what share of it the term discloses. Terms that disclose at least DISCLOSED of it, in SUPPORT independent texts or
more, are spans of the kind `term` wherever they occur, in texts without the entity too; sanitised() removes those
that disclose nearly everything, and generalises the others to their class: a name (with a capital) or a word.

All counts are of distinct texts, so copies change nothing. Near copies (texts that are alike in their words, found
by min-wise hashes) count as one independent text. Only texts that hold an entity go through the counts with their words as a row.

Defined results: null and empty texts have no spans. Repeated rows of one id and text give as many rows. An empty
table gives an empty result. Columns beside the id and the text are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, table
from leafmill.llm.components import components

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
DISCLOSED = 0.9
REMOVED = 0.97
#: Texts are near copies if their sets of words are so much alike (Jaccard).
ALIKE = 0.8
#: Texts are compared that share the least hashes of all ROWS of one of BANDS: nine tenths of the pairs that are just so much alike.
BANDS = 8
ROWS = 6
#: Rows that may be broadcast.
BROADCAST_ROWS = 100_000

# The base patterns. Possessive, and anchored to the start of a run of like characters or the end of the
# last match, so a long run is read once; what they match is what the plain patterns do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words of letters; not parts of addresses or of compounds.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{L}\p{N}@_%+-]|\.\p{L})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever and however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ends_of(lengths: Column) -> Column:
    """Running sums of an array of ints. Sums go by blocks, which keeps the copying down to some dozens a value."""
    block = 128
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    own = lambda v: F.transform(starts(F.size(v)), lambda j: F.aggregate(F.slice(v, j + 1, block), F.array().cast("array<int>"), grow))
    total = lambda blocks: F.aggregate(F.transform(blocks, lambda x: F.element_at(x, -1)), F.array(F.lit(0)), grow)
    moved = lambda blocks: let(total(blocks), lambda t: F.flatten(F.transform(blocks, lambda x, k: F.transform(x, lambda y: y + F.get(t, k)))))
    return let(lengths, lambda v: let(own(v), moved))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """What a match must fulfil beside its pattern."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), small)
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def spans_of(kind: str, text: Column, matches: Column) -> Column:
    """Array of start, rank, kind, end, value: matches with their places, failing ones dropped."""
    rank = KINDS.index(kind)

    def placed(pieces: Column) -> Column:
        n = F.size(matches)
        before = F.slice(pieces, 1, n)
        ends = ends_of(F.zip_with(before, matches, lambda p, m: F.length(p) + F.length(m)))
        each = F.arrays_zip(before, F.slice(matches, 1, n), ends)
        return F.transform(each, lambda x: F.struct(
            (x["2"] - F.length(x["1"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["2"].alias("end"), x["1"].alias("value")))

    return F.filter(let(F.split(text, PATTERNS[kind], -1), placed), lambda s: passes(kind, s["value"]))


SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def with_spans(df: DataFrame, text: Column, into: str) -> DataFrame:
    """Adds the base spans of a text, sorted by start and kind."""
    none = F.array().cast(SPAN)
    may = {"email": F.contains(text, F.lit("@")), "ip": F.lit(True), "card": F.lit(True), "phone": F.contains(text, F.lit("+"))}
    for kind in KINDS[:-1]:
        df = df.withColumn(f"_{kind}", F.when(may[kind], F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))))
    for kind in KINDS[:-1]:
        # The text is split only if a match has turned up that may hold.
        hopeful = F.exists(f"_{kind}", lambda m: passes(kind, m))  # noqa: B023
        df = df.withColumn(f"_{kind}", F.when(hopeful, spans_of(kind, text, F.col(f"_{kind}"))).otherwise(none))
    return df.withColumn(into, F.array_sort(F.concat(*[f"_{k}" for k in KINDS[:-1]]))).drop(*[f"_{k}" for k in KINDS[:-1]])


def terms_of(text: Column) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower)


def placed_terms(text: Column, wanted: Column) -> Column:
    """Array of term, start, end of every occurrence of the wanted terms."""

    def placed(words: Column) -> Column:
        rest = F.slice(F.split(text, TERM, -1), 1, F.size(words))
        ends = ends_of(F.zip_with(rest, words, lambda p, m: F.length(p) + F.length(m)))
        return F.zip_with(words, ends, lambda m, e: F.struct(F.lower(m).alias("term"), (e - F.length(m)).alias("start"), e.alias("end")))

    return F.filter(let(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), placed), lambda t: F.array_contains(wanted, t["term"]))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.xxhash64(w)))


def bands_of(words: Column) -> Column:
    """Array of BANDS hashes, each of ROWS min-wise hashes of a text's words."""
    least = lambda k: F.array_min(F.transform(words, lambda x: F.xxhash64(x, F.lit(k))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def held(df: DataFrame) -> DataFrame:
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def independent(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """mentions with `cluster`: one value for texts that are near copies of each other."""
    asked = mentions.select("text_hash").distinct()
    near = checkpointed(texts.join(held(asked), "text_hash", "left_semi").select("text_hash", F.explode(bands_of(F.col("words"))).alias("band")))
    first = near.groupBy("band").agg(F.min("text_hash").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = near.join(held(first), "band").where("text_hash <> b").select(F.col("text_hash").alias("a"), "b").distinct()
    words = lambda name: texts.select(F.col("text_hash").alias(name), F.col("words").alias(f"words_{name}"))
    same, both = F.size(F.array_intersect("words_a", "words_b")), F.size("words_a") + F.size("words_b")
    edges = met.join(words("a"), "a").join(words("b"), "b").where(same >= ALIKE * (both - same)).select("a", "b")
    roots = components(edges).withColumnRenamed("node", "text_hash")
    return mentions.join(held(roots), "text_hash", "left").withColumn("cluster", F.coalesce("root", "text_hash")).drop("root")


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, base, spans, cut (of each term's place whether it is removed): a row for each row; spans are the base
    ones and terms, sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    some = F.size("spans") > 0
    base = with_spans(source, F.col("text"), "spans")
    base = checkpointed(base.withColumn("words", F.when(some, words_of(F.col("text")))).withColumn("terms", F.when(some, terms_of(F.col("text")))).drop("text"))
    entity = F.transform("spans", lambda s: F.xxhash64(s["rank"], F.lower(F.regexp_replace(s["value"], r"[\x20().-]", ""))))
    texts = checkpointed(base.where(some).select("text_hash", "words", "terms", F.array_distinct(entity).alias("entities")).dropDuplicates(["text_hash"]))
    n_texts = base.select("text_hash").distinct().count()
    each = texts.select("text_hash", F.explode("entities").alias("entity"))
    often = held(each.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_n")).where(F.col("entity_n") >= SUPPORT))
    mentions = checkpointed(independent(checkpointed(each.join(often, "entity")), texts))
    live = mentions.select("entity", "cluster").distinct().groupBy("entity").count().where(F.col("count") >= SUPPORT).drop("count")
    mentions = mentions.join(held(live), "entity")
    # One row for each text, for each of their clusters, then for each pair of term and entity; all are summed before
    # their shuffles.
    met = mentions.join(texts.select("text_hash", "terms"), "text_hash").select("entity", "entity_n", "cluster", F.explode("terms").alias("term"))
    met = met.groupBy("entity", "entity_n", "term", "cluster").agg(F.count(F.lit(1)).alias("n"))
    pairs = met.groupBy("entity", "entity_n", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
    p_entity = F.col("entity_n") / F.lit(max(n_texts, 1))
    # What the texts with entities say of a term already bounds its share; common words end here.
    least_n = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("least_n"))
    bounded = pairs.where(p_entity < 1).join(least_n, "term").where(F.col("together") >= F.col("least_n") * F.pow(p_entity, F.lit(1 - DISCLOSED)) * 0.999999)
    pairs = held(bounded.select("entity", "entity_n", "term", "together"))

    if pairs.isEmpty():
        revealed = base.sparkSession.createDataFrame([], "text_hash long, more array<struct<start:int,rank:int,kind:string,end:int>>, cut array<struct<start:int,end:int,removed:boolean>>")
    else:
        words = source.select("text_hash", F.explode(terms_of(F.col("text"))).alias("term"))
        # An inner join: a semi-join would be moved below the explode.
        term_texts = words.join(held(pairs.select("term").distinct()), "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("term_n"))
        disclosed = (F.log2(F.least(F.col("together") / F.col("term_n"), F.lit(1.0))) - F.log2(p_entity)) / -F.log2(p_entity)
        telling = pairs.join(held(term_texts), "term").withColumn("share", disclosed).where(F.col("share") >= DISCLOSED)
        telling = held(telling.groupBy("term").agg((F.max("share") >= REMOVED).alias("removed")))
        marked = words.join(telling, "term").groupBy("text_hash").agg(F.collect_set("term").alias("wanted"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))
        revealed = source.join(held(marked), "text_hash").select("text_hash", "gone", placed_terms(F.col("text"), F.col("wanted")).alias("at")).dropDuplicates(["text_hash"]).select(
            "text_hash",
            F.transform("at", lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end"))).alias("more"),
            F.transform("at", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.array_contains("gone", t["term"]).alias("removed"))).alias("cut"))
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    revealed = held(revealed)
    return base.select("id", "text_hash", plain.alias("base")).join(revealed, "text_hash", "left").select(
        "id", "text_hash", "base", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"),
        F.coalesce(F.col("cut"), F.array().cast("array<struct<start:int,end:int,removed:boolean>>")).alias("cut"))


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS[:-1]), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text rewritten: entities as [EMAIL], [IP], [CARD], [PHONE], terms as [NAME] or [WORD], or removed. A null text stays null."""
    # The join's own columns have names that documents do not.
    own = {"id": "__pii_id", "text_hash": "__pii_hash", "spans": "__pii_spans", "cut": "__pii_cut"}
    found = found_spans(docs, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["id", "text_hash"])
    found = held(found.select(*[F.col(c).alias(n) for c, n in own.items()]))
    text, spans = F.col(text_col), F.col("__pii_spans")
    kept = docs.withColumn("__pii_of", F.xxhash64(F.coalesce(text, F.lit(""))))
    kept = kept.join(found, kept[id_col].eqNullSafe(found["__pii_id"]) & (F.col("__pii_of") == F.col("__pii_hash")), "left")
    removed = lambda s: F.exists("__pii_cut", lambda c: (c["start"] == s["start"]) & (c["end"] == s["end"]) & c["removed"])
    class_of = lambda s: F.when(F.substring(text, s["start"] + 1, F.lit(1)).rlike(r"\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
    shown = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(removed(s), F.lit("")).otherwise(class_of(s))
    zero = F.struct(F.lit(0).alias("until"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate(spans, zero, lambda a, s: F.when(s["start"] < a["until"], F.struct(F.greatest(a["until"], s["end"]).alias("until"), a["parts"].alias("parts"))).otherwise(F.struct(
        s["end"].alias("until"), F.concat(a["parts"], F.array(F.substring(text, a["until"] + 1, s["start"] - a["until"]), shown(s))).alias("parts"))))
    new = F.concat(F.array_join(parts["parts"], ""), F.substring(text, parts["until"] + 1, F.length(text)))
    return kept.withColumn(text_col, F.when(spans.isNotNull(), new).otherwise(text)).select(*docs.columns)
