"""Leaves of JSON values as rows: each value is walked once, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.batches import bounded_batches
from leafmill.sources.structured import step

#: Levels of objects and arrays that are walked into.
DEPTH = 64


class Number(str):
    """A number as it is written."""


def leaves_of(text: str | None, depth: int = DEPTH) -> Iterator[tuple[str, str, bool]]:
    """(path, value, cut) of the leaves in order, without recursion; cut: the rest below `depth` levels, as JSON."""
    try:
        value = json.loads(text or "", parse_int=Number, parse_float=Number, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return
    except RecursionError:
        yield "$", text or "", True
        return
    todo = [("$", value, 0)]
    while todo:
        path, v, level = todo.pop()
        if isinstance(v, (dict, list)) and v and level < depth:
            each = list(v.items()) if isinstance(v, dict) else list(enumerate(v))
            todo += [(step(path, k), x, level + 1) for k, x in reversed(each)]
        elif isinstance(v, (dict, list)):
            if v:
                yield path, plain(v), True
        else:
            yield path, "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v), False


def plain(value: object) -> str:
    """JSON with numbers as they were written."""
    numbers: list[str] = []

    def marked(v: object) -> object:
        if isinstance(v, Number):
            numbers.append(v)
            return f"\ue000{len(numbers) - 1}\ue001"
        if isinstance(v, dict):
            return {k: marked(x) for k, x in v.items()}
        return [marked(x) for x in v] if isinstance(v, list) else v

    out = json.dumps(marked(value), ensure_ascii=False, separators=(",", ":"))
    for k, n in enumerate(numbers):
        out = out.replace(f'"\ue000{k}\ue001"', n, 1)
    return out


def json_leaves(docs: DataFrame, id_col: str, json_col: str, depth: int = DEPTH) -> DataFrame:
    """(id, ord, path, value, cut) of the leaves: paths as $.name, $["odd name"], $[0]; values as text, null as 'null'.
    Empty objects and arrays give nothing, and a text that is not JSON gives none. What lies deeper than `depth` is one
    leaf as JSON, with cut set."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for n, leaf in enumerate(leaves_of(text, depth)):
                    at.append(k)
                    rows.append((n, *leaf))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["id", "ord", "path", "value", "cut"])

    said = docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"))
    return said.mapInArrow(walk, f"id {kind}, ord long, path string, value string, cut boolean").withColumnRenamed("id", id_col)
