"""Registered queries of the document operators, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import cells as C
from leafmill.functions import detect as D
from leafmill.functions import text as T
from leafmill.model import Options
from leafmill.operators import blocks as B
from leafmill.operators import chunks as K
from leafmill.operators import render as R
from leafmill.operators import tables as S
from leafmill.plans import extract as E
from leafmill.plans import format_queries

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LF = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
NORMAL = "regexp_replace(regexp_replace(nfc_normalize(regexp_replace({}, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')"
PARAGRAPHS = f"""
paragraphs AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, {NORMAL.format("part")} AS text
  FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k
        FROM (SELECT doc_id, regexp_split_to_array({LF}, '\\n([ \\t]*(\\n|$))+') AS parts FROM documents))
  WHERE NOT regexp_full_match(part, '[ \\t\\n]*'))"""
UNITS = "length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"
OFFSETS = f"""
sized AS (SELECT *, {UNITS} AS n FROM paragraphs),
offsets AS (
  SELECT doc_id, ord, text, CAST(coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start", n FROM sized)"""


@query(f"WITH {PARAGRAPHS} SELECT doc_id, ord, 'paragraph' AS kind, text FROM paragraphs")
def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, {NORMAL.format(LF)} AS text FROM documents")
def doc_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(f'WITH {PARAGRAPHS}, {OFFSETS} SELECT doc_id, ord, text, "start", "start" + n AS "end" FROM offsets')
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.array_offsets(B.text_arrays(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM paragraphs GROUP BY doc_id")
def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.array_text(B.text_arrays(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS n_blocks, CAST(sum({UNITS}) AS BIGINT) AS n_units, max({UNITS}) AS longest FROM paragraphs GROUP BY doc_id")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.array_stats(B.text_arrays(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


SEGMENTS = r"""
marked AS (
  SELECT doc_id, replace(regexp_replace(regexp_replace(text, '([.!?][)\]"''”’»」』]*)([ \t\r\x{A0}\x{3000}]+)([\p{Lu}0-9])', '\1' || chr(57344) || '\2' || chr(57345) || '\3', 'g'),
    '([。！？][)\]"''”’»」』]*)([ \t\r\x{A0}\x{3000}]*)([^ \t\r\x{A0}\x{3000}])', '\1' || chr(57344) || '\2' || chr(57345) || '\3', 'g'), chr(10), chr(57346) || chr(10) || chr(57345)) AS t
  FROM documents),
parts AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS k FROM (SELECT doc_id, str_split(replace(replace(t, chr(57344), chr(57347) || chr(57344)), chr(57346), chr(57347) || chr(57346)), chr(57347)) AS p FROM marked)),
cut AS (
  SELECT doc_id, k, CASE WHEN contains(part, chr(57345)) THEN str_split(part, chr(57345))[2] ELSE part END AS text,
    CASE WHEN contains(part, chr(57345)) THEN substr(str_split(part, chr(57345))[1], 2) ELSE '' END AS separator, CASE WHEN starts_with(part, chr(57346)) THEN 2 ELSE 3 END AS strength
  FROM parts),
segments AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seg, text, separator, CAST(strength AS BIGINT) AS strength FROM cut WHERE text <> '')"""


@query(f"WITH {SEGMENTS} SELECT * FROM segments")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {SEGMENTS} SELECT doc_id, count(*) AS n_segments, max(length(text)) AS longest, count(*) FILTER (strength = 3) AS n_sentences FROM segments GROUP BY doc_id")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max(F.length("text")).cast("long").alias("longest"), F.count_if(F.col("strength") == 3).alias("n_sentences"))


REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[ssn]', 'g'), '\b([0-9][ -]?){12,18}[0-9]\b', '[card]', 'g')"""


@query(f"SELECT doc_id, {REDACTED} AS text FROM documents")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


SCORE = r"""CAST(list_sum(list_transform(regexp_split_to_array(text, '[\r\n]'), lambda x: CASE WHEN regexp_matches(x, '^[ \t]*# ') THEN 2 WHEN regexp_matches(x, '^[ \t]*[-*+] ') THEN 1 WHEN regexp_matches(x, '^[ \t]*```') THEN 2 ELSE 0 END)) AS BIGINT) + CASE WHEN regexp_matches(text, '\[[^\n]*\]\(') THEN 2 ELSE 0 END"""


@query(f"SELECT doc_id, {SCORE} AS score FROM documents")
def markdown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown_score(F.col("text")).alias("score"))


COUNTS = r"""list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(substr(text, 1, 8192), '"[^"]*("|$)', 'q', 'g'), '\r\n?', chr(10), 'g'), '\n'), lambda x: NOT regexp_full_match(x, '[ \f]*')), lambda r: length(r) - length(replace(r, '{0}', ''))))"""
ROWS = r"""len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(substr(text, 1, 8192), '"[^"]*("|$)', 'q', 'g'), '\r\n?', chr(10), 'g'), '\n'), lambda x: NOT regexp_full_match(x, '[ \f]*')))"""
SAME = "(len({0}) = 1 AND ({0})[1] > 0 AND " + ROWS + " >= 2)"
DELIMITED = f"CASE WHEN {SAME.format(COUNTS.format(','))} OR {SAME.format(COUNTS.format(';'))} THEN 'csv' WHEN {SAME.format(COUNTS.format(chr(9)))} THEN 'tsv' END"


@query(f"SELECT doc_id, {DELIMITED} AS kind FROM documents")
def delimited_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.get(T.delimited_kinds(F.substring("text", 1, D.SAMPLE)), 0).alias("kind"))


KIND = rf"""CASE WHEN regexp_matches(substr(text, 1, 8192), '^[ \t\n\r\f]*[\[{{]') AND json_valid(substr(text, 1, 8192)) THEN 'json'
  WHEN regexp_matches(substr(text, 1, 8192), '(?i)^\s*<!doctype html') THEN 'html' WHEN regexp_matches(text, '(?i)^\s*<\?xml') THEN 'xml'
  WHEN regexp_matches(substr(text, 1, 8192), '(?i)</?({D.HTML_TAGS})[>/\s]') THEN 'html'
  WHEN {DELIMITED} IS NOT NULL THEN {DELIMITED} WHEN {SCORE.replace("text", "substr(text, 1, 8192)")} >= 2 THEN 'markdown' ELSE 'txt' END"""


@query(f"SELECT doc_id, {KIND} AS format FROM documents")
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.text_kind(F.col("text")).alias("format"))


@query(f"SELECT page_id, {KIND} AS format FROM (SELECT page_id, html AS text FROM pages)")
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.text_kind(F.col("html")).alias("format"))


@query(f"SELECT event_id, {KIND} AS format FROM (SELECT event_id, props AS text FROM events)")
def detect_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.text_kind(F.col("props")).alias("format"))


@query(f"""SELECT source, format, count(*) AS n FROM (SELECT 'documents' AS source, {KIND} AS format FROM documents
  UNION ALL SELECT 'pages', {KIND} FROM (SELECT html AS text FROM pages) UNION ALL SELECT 'events', {KIND} FROM (SELECT props AS text FROM events)) GROUP BY ALL""")
def detect_format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, column: table(spark, sf_dir, name).select(F.lit(name).alias("source"), D.text_kind(F.col(column)).alias("format"))
    return of("documents", "text").unionAll(of("pages", "html")).unionAll(of("events", "props")).groupBy("source", "format").agg(F.count(F.lit(1)).alias("n"))


MAGIC_ROWS = "504B0304 1F8B08 255044462D312E37 89504E470D0A1A0A FFD8FFE0 474946383961 49492A00 7B5C72746631 D0CF11E0A1B11AE1 377ABCAF271C 4D5A9000 7F454C46 664C6143 4F676753 52494646000000005745425050 000000206674797071742020 1A45DFA3 68656C6C6F"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {k})" for h, k in zip(MAGIC_ROWS.split(), "'zip' 'gzip' 'pdf' 'png' 'jpeg' 'gif' 'tiff' 'rtf' 'ole' '7z' 'exe' 'exe' 'audio' 'audio' 'webp' 'video' 'video' NULL".split())) + ") AS t(head, format)")
def magic_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(h,) for h in MAGIC_ROWS.split()], "head string")
    return rows.select("head", D.magic(F.unhex("head"))["format"].alias("format"))


LINEITEM = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]


@query("""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) + 1 AS r FROM lineitem),
each AS (SELECT l_orderkey AS sheet, r, unnest([1, 2, 3, 4, 5]) AS col, unnest([CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), printf('%.2f', l_quantity), printf('%.2f', l_extendedprice), l_returnflag]) AS text FROM numbered)
SELECT sheet, r AS row, CAST(col AS BIGINT) AS col, text, CASE WHEN col = 5 THEN 'string' ELSE 'number' END AS raw_type, chr(64 + col) || r AS address FROM each""")
def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(order) + 1)
    return S.cells_of(rows, F.col("l_orderkey"), F.col("r"), LINEITEM)


NAME = "CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) ELSE chr(65 + (n - 703) // 676) || chr(65 + ((n - 703) // 26) % 26) || chr(65 + (n - 1) % 26) END"


@query(f"SELECT p_partkey, {NAME} AS name, CAST(n AS BIGINT) AS number FROM (SELECT p_partkey, CAST((p_partkey - 1) % 16384 + 1 AS INTEGER) AS n FROM part)")
def column_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", C.column_name((F.col("p_partkey") - 1) % 16384 + 1).alias("name"))
    return rows.withColumn("number", C.column_number(F.col("name")))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS record, key, value FROM (SELECT n_nationkey, unnest(['n_nationkey', 'n_name', 'n_name_2', 'column4']) AS key,
  unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR), '']) AS value FROM nation)""")
def nation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("row"))))
    tables = table(spark, sf_dir, "nation").agg(F.transform(one, lambda x: x["row"]).alias("rows")).withColumn("header", F.array(F.lit("n_nationkey"), F.lit(" n_name"), F.lit("n_name"), F.lit("")))
    return S.to_records(tables).select("record", F.explode("pairs").alias("p")).select("record", "p.key", "p.value")


@query("""SELECT 1 AS sheet, '| Key | Name | Region |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation""")
def nation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    body = S.cells_of(nation, F.lit(1), F.col("n_nationkey") + 2, ["n_nationkey", "n_name", "n_regionkey"])
    head = spark.createDataFrame([(1, 1, k + 1, t) for k, t in enumerate(["Key", "Name", "Region"])], "sheet int, row long, col long, text string")
    return S.markdown_table(head.unionByName(body.select("sheet", "row", "col", "text")))


@query("""SELECT string_agg(n_nationkey || ',' || n_name || ',"' || n_regionkey || ',' || chr(34) || chr(34) || n_name || repeat(chr(34), 3), chr(10) ORDER BY n_nationkey) AS csv FROM nation""")
def nation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.col("n_regionkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('"'))
    line = S.csv_line([F.col("n_nationkey").cast("string"), F.col("n_name"), quoted])
    return table(spark, sf_dir, "nation").agg(B.ordered(line, F.col("n_nationkey"), "\n").alias("csv"))


@query("SELECT * FROM (VALUES ('part', CAST(1 AS BIGINT)), ('customer', CAST(1 AS BIGINT)), ('region_names', CAST(0 AS BIGINT))) AS t(sheet, header_rows)")
def header_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sheet(name: str, source: str, key: str, columns: list[str]) -> DataFrame:
        body = S.cells_of(table(spark, sf_dir, source), F.lit(name), F.col(key).cast("long") + 2, columns)
        head = spark.createDataFrame([(name, 1, k + 1, c, "string") for k, c in enumerate(columns)], "sheet string, row long, col long, text string, raw_type string")
        return head.unionByName(body.drop("address"))

    every = sheet("part", "part", "p_partkey", ["p_partkey", "p_name", "p_size"]).unionByName(sheet("customer", "customer", "c_custkey", ["c_name", "c_acctbal"])).unionByName(sheet("region_names", "region", "r_regionkey", ["r_name"]))
    return S.guess_header(every)


@query("""SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS price, format('{:,.0f}', round(l_extendedprice)) AS grouped, printf('%.0f%%', round(l_discount * 100)) AS discount FROM lineitem""")
def formatted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", C.fixed(F.col("l_extendedprice"), 2).alias("price"), C.fixed(F.col("l_extendedprice"), 0, grouped=True).alias("grouped"), C.percent(F.col("l_discount")).alias("discount"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shown FROM lineitem")
def formatted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.serial_date(serial).alias("shown"))


@query("""WITH cells AS (SELECT l_suppkey AS sheet, l_orderkey AS row, l_partkey AS col FROM lineitem),
one AS (SELECT sheet, row, col FROM cells GROUP BY ALL),
box AS (SELECT sheet, min(row) AS r1, max(row) AS r2, min(col) AS c1, max(col) AS c2, count(*) AS n FROM one GROUP BY sheet),
whole AS (SELECT * FROM box WHERE (r2 - r1 + 1) * (c2 - c1 + 1) <= greatest(10000, 4 * n)),
sparse AS (SELECT * FROM one WHERE sheet NOT IN (SELECT sheet FROM whole)),
bands AS (SELECT sheet, row, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS band FROM (SELECT DISTINCT sheet, row FROM sparse)),
banded AS (SELECT s.*, band FROM sparse s JOIN bands USING (sheet, row)),
groups AS (SELECT sheet, band, col, col - row_number() OVER (PARTITION BY sheet, band ORDER BY col) AS part FROM (SELECT DISTINCT sheet, band, col FROM banded)),
parts AS (SELECT sheet, min(row) AS first_row, max(row) AS last_row, min(col) AS first_col, max(col) AS last_col, count(*) AS n_cells FROM banded JOIN groups USING (sheet, band, col) GROUP BY sheet, band, part
  UNION ALL SELECT sheet, r1, r2, c1, c2, n FROM whole)
SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY first_row, first_col) AS region FROM parts""")
def sparse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's line items as a sheet: orders are rows, parts are columns."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"))
    return S.sheet_regions(rows, repeated=True)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("role", F.lit(": "), "text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(B.ordered(said, F.col("turn"), "\n\n").alias("text"), F.count(F.lit(1)).alias("n_turns"))


PRICE_CODES = ["0.00", "#,##0", "0%", "0000000.00", "$#,##0.00", "0.0E+00"]


@query("""SELECT l_orderkey, l_linenumber, p AS price, printf('%.2f', p) AS fixed, format('{:,.0f}', round(p)) AS grouped, printf('%.0f%%', round(l_discount * 100)) AS percent, printf('%010.2f', p) AS padded, '$' || format('{:,.2f}', p) AS money
  FROM (SELECT *, CAST(round(l_extendedprice, 2) AS DOUBLE) AS p FROM lineitem)""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and discounts shown by workbook format codes."""
    names = ["fixed", "grouped", "percent", "padded", "money"]
    price, discount = F.round("l_extendedprice", 2), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price"), *[C.shown_as(discount if n == "percent" else price, c).alias(n) for n, c in zip(names, PRICE_CODES)])


@query(r"""SELECT event_id, '$.' || key AS path, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.operators.leaves import json_leaves as leaves

    return leaves(table(spark, sf_dir, "events"), "event_id", "props").select("event_id", "path", "value")


@query(r"""SELECT page_id, regexp_matches(html, '(?i)<script[\s>]|<[a-z][^>]*\son[a-z]+\s*=') AS has_java_script, regexp_matches(html, '(?i)<(img|link|iframe|source)\s[^>]*(src|href)\s*=\s*["'']?(https?:)?//') AS has_external_links FROM pages""")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.functions.html import has_external_links, has_script

    return table(spark, sf_dir, "pages").select("page_id", has_script(F.col("html")).alias("has_java_script"), has_external_links(F.col("html")).alias("has_external_links"))


@query("""SELECT i AS n, CASE WHEN i = 0 THEN '' ELSE repeat(chr(97 + (i - 1) % 26), (i - 1) // 26 + 1) END AS letters FROM (SELECT CAST(n_nationkey AS INTEGER) * 3 AS i FROM nation) WHERE i > 0""")
def list_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).alias("n")).where("n > 0")
    return rows.select("n", C.letters_marker(F.col("n")).alias("letters"))


def extracted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))
    return E.extract(pages, options=Options(format="html", **options))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS heading FROM pages""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blocks_of(extracted(spark, sf_dir)).where("kind = 'heading'").select(F.col("doc_id").alias("page_id"), F.col("text").alias("heading"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages""")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = E.blocks_of(extracted(spark, sf_dir)).where("kind = 'list'")
    return lists.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(F.size("items")).alias("n_items"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blocks_of(extracted(spark, sf_dir)).select("doc_id", "ord", "parent_ord", "depth", "kind", "level", "text", "start", "end")


@query()
def page_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir, main_content=True).select(F.col("doc_id").alias("page_id"), "text")


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_markdown(extracted(spark, sf_dir)).select(F.col("doc_id").alias("page_id"), "markdown")


@query()
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_json(extracted(spark, sf_dir)).select(F.col("doc_id").alias("page_id"), "json")


@query()
def chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_arrays(B.array_blocks(B.text_arrays(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id"), "doc_id", strategy="size")


BARE = r"regexp_replace(text, '[ \t\n]', '', 'g')"


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, sha256(string_agg({BARE}, '' ORDER BY ord)) AS bare_sha256, true AS fit FROM paragraphs GROUP BY doc_id""")
def chunks_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together again without what they repeat: all text but white space, in order, and no chunk too long."""
    made = K.chunk_arrays(B.array_blocks(B.text_arrays(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id"), "doc_id", strategy="section", max_size=300, overlap=60)
    # Overlaps count UTF-16 units; in them a place may be told for any text.
    raw = F.encode("text", "UTF-16BE")
    new = F.regexp_replace(F.decode(F.substring(raw, 2 * F.col("overlap") + 1, F.octet_length(raw)), "UTF-16BE"), "[ \t\n]", "")
    each = made.select("doc_id", "index", new.alias("text"), (F.octet_length(raw) <= 600).alias("fit"))
    return each.groupBy("doc_id").agg(F.sha2(B.ordered(F.col("text"), F.col("index"), ""), 256).alias("bare_sha256"), F.bool_and("fit").alias("fit"))


@query()
def chunk_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: each turn's role is a heading over what was said."""
    said = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.array(
        F.struct((2 * F.col("turn")).alias("ord"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.col("role").alias("text")),
        F.struct((2 * F.col("turn") + 1).alias("ord"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("text").alias("text")))).alias("b")).select("conv_id", "b.*")
    return K.with_context(K.chunk_blocks(said, "conv_id", strategy="section", max_size=600), "conv_id")


@query("SELECT * FROM (VALUES ('csv', 'csv', CAST(1 AS BIGINT)), ('json', 'json', CAST(2 AS BIGINT)), ('xml', 'xml', CAST(2 AS BIGINT)), ('md', 'markdown', CAST(2 AS BIGINT)), ('srt', 'srt', CAST(1 AS BIGINT)), ('eml', 'eml', CAST(2 AS BIGINT))) AS t(name, format, n_blocks)")
def extract_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {
        "csv": "a,b\n1,2\n", "json": '{"k": 1}', "xml": "<?xml version='1.0'?><r><a>x</a><a>y</a></r>", "md": "# Head\n\n- one\n- two\n", "srt": "1\n00:00:01,000 --> 00:00:02,000\nHello\n",
        "eml": "From: a@b.example\nTo: c@d.example\nSubject: s\n\nBody\n",
    }
    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in files.items()], "name string, content binary")
    return E.extract(rows, "name").select(F.col("doc_id").alias("name"), "format", F.size("blocks").cast("long").alias("n_blocks"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'nation' || n_nationkey || '.txt' AS path, n_name AS text FROM nation""")
def zip_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's name in a ZIP of its own; the child documents of the archives."""

    def packed(frames):
        import io
        import zipfile

        for pdf in frames:
            made = []
            for n, name in zip(pdf["n_nationkey"], pdf["n_name"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(f"nation{n}.txt", name)
                made.append((int(n), out.getvalue()))
            yield pd.DataFrame(made, columns=["doc_id", "content"])

    files = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(packed, "doc_id long, content binary")
    return E.extract(files).where("depth = 1").select("doc_id", "path", "text")


@query()
def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with quoted lines and a forwarded message added, which are cut away again. Turns may have quotes and
    marks of their own, which SQL cannot follow; tests hold it against brute force."""
    mail = F.concat(F.col("text"), F.lit("\n> earlier\nBye\n\nOn Monday, A B <a@b.c> wrote:\n> all of it\nmore"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.drop_quoted(mail).alias("text"))


@query("SELECT p_partkey, 'a/' || p_name || '/c.txt' AS path FROM part")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_path(F.concat(F.lit("C:\\a\\.\\"), F.col("p_name"), F.lit("/..//c.txt"))).alias("path"))


ROMAN = "['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]"


@query(f"""SELECT p_partkey, ['', 'm', 'mm', 'mmm'][n // 1000 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || {ROMAN} AS marker
  FROM (SELECT p_partkey, CAST(p_partkey % 3999 + 1 AS INTEGER) AS n FROM part)""")
def roman_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.roman(F.col("p_partkey") % 3999 + 1).alias("marker"))


@query("""WITH cells AS (SELECT CAST(n_regionkey AS BIGINT) AS sheet, CAST(n_nationkey AS BIGINT) + 1 AS row, CAST(length(n_name) AS BIGINT) AS col, n_name AS text FROM nation),
box AS (SELECT sheet, min(row) AS r1, max(row) AS r2, min(col) AS c1, max(col) AS c2 FROM cells GROUP BY sheet),
grid AS (SELECT sheet, unnest(generate_series(r1, r2)) AS row, c1, c2 FROM box), full_grid AS (SELECT sheet, row, unnest(generate_series(c1, c2)) AS col FROM grid)
SELECT sheet, CAST(1 AS BIGINT) AS region, row, col, coalesce(text, '') AS text FROM full_grid LEFT JOIN cells USING (sheet, row, col)""")
def region_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("sheet"), (F.col("n_nationkey").cast("long") + 1).alias("row"), F.length("n_name").cast("long").alias("col"), F.col("n_name").alias("text"))
    return S.region_rows(cells, S.sheet_regions(cells)).select("sheet", "region", "row", "col", "text")


@query("""SELECT CAST(p_size AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS BIGINT) AS row, CAST(unnest([1, 2, 3]) AS BIGINT) AS col, unnest([CAST(p_partkey AS VARCHAR), p_name || ',"' || p_brand || '"', p_type]) AS text FROM part""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one CSV file for each size, read back to cells."""
    line = S.csv_line([F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(',"'), "p_brand", F.lit('"')), F.col("p_type")])
    files = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("doc_id")).agg(F.encode(B.ordered(line, F.col("p_partkey"), "\r\n"), "UTF-8").alias("content"))
    tables = E.blocks_of(E.extract(files, options=Options(format="csv"))).where("kind = 'table'")
    rows = tables.select("doc_id", "ord", F.posexplode("rows").alias("r", "cells")).select("doc_id", (F.col("ord") * 1000 + F.col("r") + 1).cast("long").alias("row"), F.posexplode("cells").alias("c", "cell"))
    return rows.select("doc_id", "row", (F.col("c") + 1).cast("long").alias("col"), "cell.text")


@query("""SELECT event_id, '$.' || key AS path, '$.' || key || ': ' || json_extract_string(props, '$.' || key) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def json_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.encode("props", "UTF-8").alias("content"))
    return E.blocks_of(E.extract(files)).where("kind = 'paragraph'").select(F.col("doc_id").alias("event_id"), "path", "text")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n_leaves FROM (SELECT user_id, unnest(json_keys(props)) AS key FROM events) GROUP BY user_id""")
def ndjson_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one NDJSON file for each user, read back to leaves."""
    files = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.encode(B.ordered(F.col("props"), F.col("event_id"), "\n"), "UTF-8").alias("content"))
    found = E.blocks_of(E.extract(files, options=Options(format="ndjson"))).where("kind = 'paragraph'")
    return found.groupBy(F.col("doc_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n_leaves"))


@query("""SELECT conv_id, turn, 'message-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn)) || '.eml' AS path, role || '@mail.example' AS sender FROM conversations""")
def mailbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mailboxes, a message for each turn; the messages' senders."""
    message = F.concat(F.lit("From x\nFrom: "), F.col("role"), F.lit("@mail.example\nTo: all@mail.example\nSubject: "), F.col("turn").cast("string"), F.lit("\n\nbody\n\n"))
    files = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.encode(B.ordered(message, F.col("turn"), ""), "UTF-8").alias("content"))
    found = E.blocks_of(E.extract(files)).where("kind = 'table' and child_path <> ''")
    value = lambda k: F.get(F.get("rows", k), 1)["text"]
    return found.select(F.col("doc_id").alias("conv_id"), value(3).cast("long").alias("turn"), F.col("child_path").alias("path"), value(1).alias("sender"))


@query()
def document_chunks_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of pages with their headings, for retrieval."""
    return K.with_context(K.chunk_arrays(extracted(spark, sf_dir), "doc_id", strategy="section", max_size=800, overlap=100), "doc_id")


@query("""SELECT doc_id, count(*) AS n_long FROM documents WHERE length(text) > 0 AND n_chars > 100 GROUP BY doc_id""")
def transform_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-block hook as a filter: documents' texts as blocks, those over 100 characters kept."""
    blocks = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    kept = B.transform_blocks(blocks, lambda df: df.withColumn("text", F.when(F.length("text") > 100, F.col("text"))))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_long"))


QUERIES |= format_queries.QUERIES
ORACLE_SQL |= format_queries.ORACLE_SQL
