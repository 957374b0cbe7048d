"""Quality rules: base rules on text statistics, and an isolation forest on the same statistics.

The forest is fitted on all labelled rows. Rates of the statistics are centred and scaled by the median and spread of
all good rows that grow it. One half of the good rows, by a hash of id and text, grows the trees; the other half and
the bad rows calibrate the score from which a document is rejected. Medians, spreads and the threshold are exact, by
passes that count: only counts of bounded number, and the rows of the trees, reach the driver. As the method has it,
each tree draws its 256 rows (those of least hash with the tree's number), from all rows that grow the forest. Short
path lengths over the random splits mark anomalous documents.

Defined results: a null or empty text has no words, so it fails the base rules and is rejected. Each input row gives
one output row, repeated rows included. Without labelled rows of both kinds there is no threshold, and the base rules
alone decide. Columns beside the id and the text are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import SPACES, checkpointed, small_batches, table

#: Labels that may be broadcast; more are joined by shuffle, with the statistics of all texts.
BROADCAST_ROWS = 200_000
#: Trees, rows that each draws and hashes for it, and the unit of fixed-point sums, which are the same in any order.
TREES = 100
TREE_ROWS = 256
TREE_SALTS = np.random.default_rng(7).integers(0, 1 << 64, TREES, dtype=np.uint64)
UNIT = 2.0**-20
#: Share of the good labelled rows that the threshold may reject, at most.
MOST_GOOD_LOST = 0.002

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = b"!?"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_marks", "n_stutters"]
RATES = ["chars", "symbols", "repeats", "upper", "marks", "stutters"]


def rule_stats(text: str | None) -> tuple[int, ...]:
    """STATS and EXTRA of one whole text."""
    if not text:
        return (0,) * (len(STATS) + len(EXTRA))
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        often, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeat += i + 5 - max(i, until)
                until = i + 5
    rest = tuple(len(raw) - len(raw.translate(None, x)) for x in (UPPER, MARKS))
    return len(words), word_chars, symbols, dup_lines, repeat, *rest, sum(map(eq, words, words[1:]))


def rates(stats: np.ndarray) -> np.ndarray:
    """Rule statistics (rows of STATS + EXTRA) by word: the length of a text says nothing of its quality."""
    n, chars, symbols, _, repeat, upper, marks, stutters = stats.T.astype(float)
    return np.stack([chars, symbols, repeat, upper, marks, stutters], axis=1) / np.maximum(n, 1)[:, None]


@dataclass
class Forest:
    """Random split trees in arrays: node k of a tree has children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x nodes; -1 at leaves
    cut: np.ndarray
    length: np.ndarray  # path length that a leaf stands for
    norm: float
    centre: np.ndarray
    scale: np.ndarray
    threshold: float = float("inf")

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 to the power of minus the mean path length over its expectation."""
        x = scaled(rates(stats), self.centre, self.scale)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := (f := feature[node]) >= 0).any():
                right = x[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / (len(self.feature) * self.norm))


def expected_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n keys in a random binary tree."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rates in units of their spread, long tails drawn in."""
    return np.arcsinh((x - centre) / scale)


def moments(stats: np.ndarray) -> list[int]:
    """Exact sums over rows of STATS and EXTRA: rows, words, rates in UNITs, squares of these."""
    units = [[int(v) for v in column] for column in np.rint(rates(stats) / UNIT).T]
    return [len(stats), int(stats[:, 0].sum()), *map(sum, units), *(sum(v * v for v in column) for column in units)]


def spread(sums: list[int]) -> np.ndarray:
    """Deviations of the rates, from moments; none is less than what one sign makes in a text of mean length."""
    n, words, *rest = sums
    one, two = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    return np.maximum([UNIT * np.sqrt((n * b - a * a) / n**2) for a, b in zip(one, two)], 1 / max(1.0, words / n))


def fit_forest(stats: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """A forest over rows of STATS and EXTRA that lie in memory."""
    rng = np.random.default_rng(seed)
    drawn = [stats[rng.choice(len(stats), min(rows, len(stats)), replace=False)] for _ in range(trees)]
    return grown_forest(drawn, np.quantile(rates(stats), 0.5, axis=0, method="lower"), spread(moments(stats)), seed)


def grown_forest(drawn: list[np.ndarray], centre: np.ndarray, scale: np.ndarray, seed: int = 7) -> Forest:
    """A tree for each of the arrays of rows of STATS and EXTRA, all of one length."""
    trees, rows = len(drawn), len(drawn[0])
    rng = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    cut, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, 0, scaled(rates(drawn[t]), centre, scale))]
        while todo:
            k, d, part = todo.pop()
            if d == depth or len(part) <= 1:
                length[t, k] = d + expected_length(len(part))
                continue
            low, high = part.min(axis=0), part.max(axis=0)
            # A split may fall outside the part's own range, so values that no fitted row has are parted early, of
            # rates too that are the same in all fitted rows.
            margin = high - low + 1
            f = rng.integers(part.shape[1])
            feature[t, k], cut[t, k] = f, rng.uniform(low[f] - margin[f], high[f] + margin[f])
            right = part[:, f] > cut[t, k]
            todo += [(2 * k + 1, d + 1, part[~right]), (2 * k + 2, d + 1, part[right])]
    return Forest(feature, cut, length, max(expected_length(rows), 1e-9), centre, scale)


def passes_base(s: np.ndarray) -> np.ndarray:
    """s: rows of STATS and EXTRA."""
    return (s[:, 0] >= 10) & (100 * s[:, 4] <= 20 * s[:, 0])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS + EXTRA], axis=1)


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, statistics) of texts."""
    for b in batches:
        s = np.array([rule_stats(t) for t in b.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(STATS + EXTRA))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), *map(pa.array, s.T)], names=["id", "mark", *STATS, *EXTRA])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(quality, mark, statistics): a row for each id, text and label. mark is a hash of id and text."""
    known = labels.where("quality is not null").select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
    known = checkpointed(known.distinct())
    few = known.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if few:
        texts = texts.join(F.broadcast(known.select("id").distinct()), "id", "left_semi")
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, mark long, " + ", ".join(f"{c} long" for c in STATS + EXTRA)
    measured = texts.select("id", F.xxhash64("id", "text").alias("mark"), "text").mapInArrow(_stats_rows, schema)
    return measured.join(F.broadcast(known) if few else known, "id").select("quality", "mark", *STATS, *EXTRA).distinct()


def order_statistics(values: DataFrame, ranks: list[int]) -> np.ndarray:
    """Of each column of values (doubles from 0 up) the one of the given rank, from 0, exactly. The bits of such doubles
    are in the order of the doubles; a pass settles 16 of them by counts."""
    found, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):

        def count(batches: Iterator[pa.RecordBatch], found: tuple[int, ...] = tuple(found), shift: int = shift) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(found), 65536), dtype=np.int64)
            for b in batches:
                for k, column in enumerate(b.columns):
                    bits = column.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(shift)
                    digits, n = np.unique(bits[bits >> np.uint64(16) == found[k]] & np.uint64(0xFFFF), return_counts=True)
                    total[k, digits.astype(np.int64)] += n
            k, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(digit), pa.array(total[k, digit])], names=["k", "digit", "n"])

        counts = values.mapInArrow(count, "k long, digit long, n long").groupBy("k", "digit").agg(F.sum("n").alias("n")).toPandas().sort_values("digit")
        for k in range(len(ranks)):
            mine = counts[counts["k"] == k]
            up_to = mine["n"].cumsum().to_numpy()
            at = int(np.searchsorted(up_to, left[k], side="right"))
            found[k] = found[k] << 16 | int(mine["digit"].iloc[at])
            left[k] -= int(up_to[at - 1]) if at else 0
    return np.array(found, dtype=np.uint64).view(np.float64)


def summed(stats: DataFrame) -> list[int]:
    """moments() of all rows; a row of sums comes from each task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(moments(np.zeros((0, len(STATS + EXTRA)), dtype=np.int64)))
        for b in batches:
            total = [x + y for x, y in zip(total, moments(_stats_of(b)))]
        yield pa.RecordBatch.from_arrays([pa.array([[str(x) for x in total]], pa.list_(pa.string()))], names=["sums"])

    return [sum(map(int, column)) for column in zip(*(r["sums"] for r in stats.select(*STATS, *EXTRA).mapInArrow(part, "sums array<string>").collect()))]


def draws(grown: DataFrame, n: int) -> list[np.ndarray]:
    """For each tree TREE_ROWS of the n rows of grown (all if there are fewer), those of the least hashes of mark and tree."""
    share = (1.25 * TREE_ROWS + 64) / n
    while True:

        def drawn(batches: Iterator[pa.RecordBatch], share: float = share) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mark = b.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
                h = (mark[None, :] ^ TREE_SALTS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
                order = ((h ^ h >> np.uint64(30)) >> np.uint64(11)) * 2.0**-53
                tree, row = np.nonzero(order < share)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(order[tree, row]), *map(pa.array, _stats_of(b)[row].T)], names=["tree", "place", *STATS, *EXTRA])

        schema = "tree long, place double, " + ", ".join(f"{c} long" for c in STATS + EXTRA)
        found = grown.select("mark", *STATS, *EXTRA).mapInArrow(drawn, schema).toPandas().sort_values(["tree", "place", *STATS, *EXTRA])
        parts = [found[found["tree"] == t][STATS + EXTRA].to_numpy()[:TREE_ROWS] for t in range(TREES)]
        if min(map(len, parts)) >= min(n, TREE_ROWS):
            return parts
        share *= 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = None) -> Forest | None:
    """The calibrated forest, or None without labelled rows of both kinds. Reads all labelled rows; a caller may ask for
    those sample_rows that have the least hashes of id and text."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col)
    if sample_rows is not None:
        rows = rows.orderBy("mark", *STATS, *EXTRA, "quality").limit(sample_rows)
    rows = checkpointed(rows)
    base = "n_words >= 10 and 100 * n_repeat_words <= 20 * n_words"
    grown, held = rows.where(f"{base} and quality = 1 and mark % 2 = 0"), rows.where(f"{base} and quality = 1 and mark % 2 <> 0")
    n, n_held, n_bad = rows.agg(*(F.count_if(F.expr(x)) for x in (f"{base} and quality = 1 and mark % 2 = 0", f"{base} and quality = 1 and mark % 2 <> 0", "quality = 0"))).first()
    if n < 8 or not n_held or not n_bad:
        return None

    def rate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, rates(_stats_of(b)).T)], names=RATES)

    by_word = grown.select(*STATS, *EXTRA).mapInArrow(rate_rows, ", ".join(f"{c} double" for c in RATES))
    forest = grown_forest(draws(grown, n), order_statistics(by_word, [(n - 1) // 2] * len(RATES)), spread(summed(grown)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_stats_of(b)))], names=["score"])

    # The threshold is the lowest that loses at most MOST_GOOD_LOST of the good, midway to the next bad score.
    scored = lambda some: checkpointed(some.select(*STATS, *EXTRA).mapInArrow(scores, "score double"))
    low = float(order_statistics(scored(held), [n_held - 1 - int(MOST_GOOD_LOST * n_held)])[0])
    above = scored(rows.where(f"{base} and quality = 0")).where(F.col("score") > F.lit(low)).agg(F.min("score")).first()[0]
    forest.threshold = low + 1e-9 if above is None else (low + above) / 2
    return forest


def quality_rules(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """One row for each row of docs: id, STATS, EXTRA, anomaly, base_failed and kept; or with keep_columns the kept
    rows of docs with all their columns."""
    small_batches(docs.sparkSession)
    shared = forest

    def judged(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s = np.array([rule_stats(t) for t in texts], dtype=np.int64).reshape(-1, len(STATS + EXTRA))
        base = passes_base(s)
        score = shared.score(s) if shared and len(s) else np.zeros(len(s))
        return s, score, base, base & (score <= shared.threshold if shared else True)

    if keep_columns:

        @F.pandas_udf("boolean")
        def kept(texts: pd.Series) -> pd.Series:
            return pd.Series(judged(list(texts))[3])

        return docs.where(kept(F.col(text_col)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, score, base, kept = judged(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, s.T), pa.array(score), pa.array(~base), pa.array(kept)],
                names=["id", *STATS, *EXTRA, "anomaly", "base_failed", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in STATS + EXTRA) + ", anomaly double, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, schema).withColumnRenamed("id", id_col)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *STATS, "base_failed", "kept", "anomaly")
