"""Block tables: reading plain texts, offsets, rendering as text, filters on blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import nfc, normalize_text, paragraphs, segments, utf16_length


def text_blocks(docs: DataFrame, id_col: str, text_col: str, composed: bool = False) -> DataFrame:
    """(id, ord, kind, text): the paragraphs of plain texts, normalised. One pass, no shuffle."""
    each = docs.select(id_col, F.posexplode(paragraphs(F.col(text_col))).alias("ord", "text"))
    return each.select(id_col, F.col("ord").cast("long").alias("ord"), F.lit("paragraph").alias("kind"), normalize_text(F.col("text"), composed).alias("text"))


def text_arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, texts): the paragraphs of each plain text as an array, normalised. A document stays one row, so what follows
    needs no shuffle."""
    whole = docs.select(id_col, nfc(F.col(text_col)).alias("_text"))
    return whole.select(id_col, F.transform(paragraphs(F.col("_text")), lambda p: normalize_text(p, composed=True)).alias("texts"))


def array_blocks(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, blocks): paragraphs as block structs."""
    return docs.select(id_col, F.transform("texts", lambda t: F.struct(F.lit("paragraph").alias("kind"), t.alias("text"))).alias("blocks"))


def array_offsets(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, ord, text, start, end) of each paragraph in the document's text: sums inside the row, exploded last."""
    sizes = F.transform("texts", utf16_length)
    ends = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + 2, F.lit(0).cast("long")) + n)))
    each = docs.select(id_col, "texts", sizes.alias("_n"), ends.alias("_ends"))
    each = each.select(id_col, F.posexplode(F.arrays_zip("texts", "_n", "_ends")).alias("ord", "b"))
    return each.select(id_col, F.col("ord").cast("long").alias("ord"), F.col("b.texts").alias("text"), (F.col("b._ends") - F.col("b._n")).alias("start"), F.col("b._ends").alias("end"))


def array_text(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, text): paragraphs in order, parted by two line ends; documents without any are left out."""
    return docs.where(F.size("texts") > 0).select(id_col, F.array_join("texts", "\n\n").alias("text"))


def array_stats(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, n_blocks, n_units, longest) of the paragraphs."""
    sizes = F.transform("texts", utf16_length)
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)
    return docs.where(F.size("texts") > 0).select(id_col, F.size("texts").cast("long").alias("n_blocks"), total.alias("n_units"), F.array_max(sizes).alias("longest"))


def with_offsets(blocks: DataFrame, id_col: str, text: str = "text", ord_col: str = "ord") -> DataFrame:
    """Adds start and end of each block in the document's text, in UTF-16 units; blocks are parted by two line ends."""
    before = Window.partitionBy(id_col).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
    size = utf16_length(F.col(text))
    start = F.coalesce(F.sum(size + 2).over(before), F.lit(0))
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + size)


def ordered(text: Column, order: Column, separator: str) -> Column:
    """Ordered concatenation as an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), separator)


def to_text(blocks: DataFrame, id_col: str, text: str = "text", ord_col: str = "ord") -> DataFrame:
    """(id, text): blocks in order, parted by two line ends even where one is empty."""
    return blocks.groupBy(id_col).agg(ordered(F.col(text), F.col(ord_col), "\n\n").alias("text"))


def transform_blocks(blocks: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The per-block hook: any change of the block table; rows with a null text are dropped after it."""
    return change(blocks).where(F.col("text").isNotNull())


def sentence_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seg, text, separator, strength) of the segments of texts."""
    each = docs.select(id_col, F.posexplode(segments(F.col(text_col))).alias("seg", "s"))
    return each.select(id_col, F.col("seg").cast("long").alias("seg"), "s.text", "s.separator", F.col("s.strength").cast("long").alias("strength"))


def text_stats(blocks: DataFrame, id_col: str) -> DataFrame:
    return blocks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(utf16_length(F.col("text"))).alias("n_units"), F.max(utf16_length(F.col("text"))).alias("longest"))
