"""Table operators over a long table of cells (sheet, row, col, text, and raw_type where values are typed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.cells import cell_address, fixed


def cells_of(df: DataFrame, sheet: Column, row: Column, columns: list[str]) -> DataFrame:
    """(sheet, row, col, text, raw_type, address) of the rows of a table; row 1 is left for a header."""
    kinds = dict(df.dtypes)
    typed = lambda c: "string" if kinds[c] == "string" else "boolean" if kinds[c] == "boolean" else "number"
    shown = lambda c: fixed(F.col(c), 2) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    each = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("col"), shown(c).alias("text"), F.lit(typed(c)).alias("raw_type")) for k, c in enumerate(columns)])
    rows = df.select(sheet.alias("sheet"), row.cast("long").alias("row"), F.explode(each).alias("c"))
    return rows.select("sheet", "row", "c.col", "c.text", "c.raw_type", cell_address(F.col("row"), F.col("c.col")).alias("address"))


#: Bytes, by Spark's own estimate, of the cells that one task is dealt; and the most that counts as an estimate.
TASK_BYTES, TOLD_BYTES = 1 << 20, 1 << 50


def by_sheet(cells: DataFrame) -> DataFrame:
    """Cells dealt by their sheet, to more tasks the more of them there are, so no task's share grows with the input."""
    size = int(cells._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(max(least, size // TASK_BYTES) if size < TOLD_BYTES else least, "sheet")


def sheet_regions(cells: DataFrame, dense: int = 10_000, factor: int = 4, repeated: bool = False) -> DataFrame:
    """(sheet, region, first_row, last_row, first_col, last_col, n_cells): a sheet's one bounding box if its area is at most
    max(dense, factor * cells); else bands of adjacent rows, parted again into groups of adjacent columns. repeated: cells
    may occur more than once, and count once.

    Cells are read and dealt once. A sheet's cells are sorted in one task, and spilled where they are many.
    """
    own = by_sheet(cells.select("sheet", "row", "col"))
    own = own.distinct() if repeated else own
    sheet = Window.partitionBy("sheet")
    box = own.sortWithinPartitions("sheet", "row").select("*", *[f(c).over(sheet).alias(n) for n, f, c in (("r1", F.min, "row"), ("r2", F.max, "row"), ("c1", F.min, "col"), ("c2", F.max, "col"))], F.count(F.lit(1)).over(sheet).alias("n"))
    area = (F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1)
    told = box.withColumn("whole", area <= F.greatest(F.lit(dense).cast("long"), factor * F.col("n"))).drop("r1", "r2", "c1", "c2", "n")
    told = told.where("whole or (not whole and sheet is not null and row is not null and col is not null)")
    # A gap between two of a sheet's rows starts a band, and one between two of a band's columns a part.
    gap = lambda c, w: F.when(~F.col("whole"), F.col(c) - F.dense_rank().over(w.orderBy(c)))
    parts = told.withColumn("band", gap("row", sheet)).withColumn("part", gap("col", Window.partitionBy("sheet", "band"))).groupBy("sheet", "band", "part").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count(F.lit(1)).alias("n_cells")).drop("band", "part")
    return parts.withColumn("region", F.row_number().over(sheet.orderBy("first_row", "first_col")).cast("long"))


def region_rows(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(sheet, region, row, col, text) of the full grid of each region; empty cells have an empty text."""
    grid = regions.select("sheet", "region", F.explode(F.sequence("first_row", "last_row")).alias("row"), "first_col", "last_col").select("sheet", "region", "row", F.explode(F.sequence("first_col", "last_col")).alias("col"))
    return grid.join(cells.select("sheet", "row", "col", "text"), ["sheet", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def guess_header(cells: DataFrame, mode: str | bool = "auto", sample: int = 20) -> DataFrame:
    """(sheet, header_rows): 1 if the first row is all text, labels half of its columns at least, and a labelled column has
    a number or boolean in the next rows. One grouping; only the first rows of a sheet are kept for it."""
    if mode != "auto":
        return cells.select("sheet").distinct().withColumn("header_rows", F.lit(int(bool(mode))).cast("long"))
    first = cells.groupBy("sheet").agg(F.min("row").alias("top"), F.max("row").alias("bottom"))
    near = cells.join(first, "sheet").where(F.col("row") <= F.col("top") + sample)
    typed = F.col("raw_type").isin("number", "boolean")
    head = F.col("row") == F.col("top")
    label = head & (F.trim("text") != "")
    by_col = near.groupBy("sheet", "col").agg(F.max(head).alias("in_head"), F.max(head & typed).alias("head_typed"), F.max(label).alias("labelled"), F.max(~head & typed).alias("body_typed"), F.max(F.col("bottom") > F.col("top")).alias("more"))
    got = by_col.groupBy("sheet").agg(
        F.max("head_typed").alias("t"), F.sum(F.col("labelled").cast("int")).alias("n"), F.sum(F.col("in_head").cast("int")).alias("w"), F.max(F.col("labelled") & F.col("body_typed")).alias("told"), F.max("more").alias("more"))
    return got.select("sheet", (F.col("more") & ~F.col("t") & (F.col("n") > 0) & (2 * F.col("n") >= F.col("w")) & F.col("told")).cast("long").alias("header_rows"))


def record_keys(header: Column) -> Column:
    """Keys of records from an array of header texts: trimmed, column1.. where empty, name_2.. where repeated."""
    named = F.transform(header, lambda h, i: F.when(F.trim(h) != "", F.trim(h)).otherwise(F.concat(F.lit("column"), (i + 1).cast("string"))))
    return F.transform(named, lambda k, i: F.when(F.size(F.filter(F.slice(named, 1, i), lambda x: x == k)) > 0, F.concat(k, F.lit("_"), (F.size(F.filter(F.slice(named, 1, i), lambda x: x == k)) + 1).cast("string"))).otherwise(k))


def to_records(tables: DataFrame, header: str = "header", rows: str = "rows") -> DataFrame:
    """One row for each record of tables with an array of header texts and an array of rows of texts: its number and
    an ordered array of key and value; missing cells are empty."""
    keyed = tables.withColumn("_keys", record_keys(F.col(header)))
    each = keyed.select(*[c for c in tables.columns if c not in (header, rows)], "_keys", F.posexplode(rows).alias("record", "_row"))
    pairs = F.transform("_keys", lambda k, i: F.struct(k.alias("key"), F.coalesce(F.get("_row", i), F.lit("")).alias("value")))
    return each.select(*[c for c in tables.columns if c not in (header, rows)], F.col("record").cast("long").alias("record"), pairs.alias("pairs"))


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\|])", r"\\$1"), "\n", "<br>")


def markdown_table(cells: DataFrame, max_rows: int = 200, max_columns: int = 50) -> DataFrame:
    """(sheet, markdown): a pipe table of each sheet, its first row as the header, with what is left out said below."""
    size = cells.groupBy("sheet").agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))
    kept = cells.where((F.col("row") <= max_rows + 1) & (F.col("col") <= max_columns))
    lines = kept.groupBy("sheet", "row").agg(F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", markdown_cell(F.col("text")).alias("t")))), lambda x: x["t"]), " | "), F.lit(" |")).alias("line"), F.count(F.lit(1)).alias("width"))
    body = lines.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"), F.max("width").alias("width"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int")))
    more_rows, more_cols = F.greatest(F.col("n_rows") - 1 - max_rows, F.lit(0)), F.greatest(F.col("n_cols") - max_columns, F.lit(0))
    note = F.when((more_rows > 0) & (more_cols > 0), F.concat(F.lit("\n\n… "), more_rows, F.lit(" more rows and "), more_cols, F.lit(" more columns not shown"))).when(more_rows > 0, F.concat(F.lit("\n\n… "), more_rows, F.lit(" more rows not shown"))).when(more_cols > 0, F.concat(F.lit("\n\n… "), more_cols, F.lit(" more columns not shown"))).otherwise("")
    table = F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", 2, max_rows)), "\n")
    return body.join(size, "sheet").select("sheet", F.concat(table, note).alias("markdown"))


def csv_line(texts: list[Column]) -> Column:
    """A CSV row with quotes where they are needed."""
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts]
    return F.concat_ws(",", *quoted)
