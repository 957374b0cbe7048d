"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) P(group | class, context) P(token | group). Tokens are dealt by hash to groups,
at most 2 ** DEPTH[1] of them, growing with the vocabulary, and groups to 2 ** CLASS_BITS classes. Both softmaxes are factored in turn into
two-way ones along a tree, whose decisions make a token's path. Each decision adds up, beside the log odds of the two
sides' counts, the weights of hashed features of the context crossed with the place in the tree: the last token, the
last two, and as skip feature the token before the last. So features tell which tokens follow, and without weights the
model is that of the counts. P(token | group) is the token's smoothed share of its group, with one share for all
tokens that are new there. The probabilities of all tokens, new ones of a group as one, sum up to 1.

Counts cover every training document: workers count distinct tokens before the shuffle, keyed by 64-bit hashes.
Training goes through every training document once, in ROUNDS rounds: tasks sum, weight by weight, the gradient and
the curvature of the log likelihood over their share of the round's documents; the sums of all tasks, made block by
block on the executors as a stream, give one damped Newton step for all weights. Sums do not depend on how documents
are dealt to tasks, so scores do not either, but for rounding (sums travel with 8 bits of fraction). Weights are hashed to slots, at least SLOT_BITS[0]
and at most SLOT_BITS[1] bits, in number four times the vocabulary; no task and not the driver holds more than these.
Scoring runs in sparse numpy batches of the weights that a token's path and features name.

Tokens that make up at least 1 / HEAVY_SHARE of the training tokens (so HEAVY_SHARE at most) have their counts sent to
the workers; a document's other tokens are joined with the counts by hash, and no such token is frequent enough to
unbalance that join.

Defined results: a null or empty text is the end token alone. Repeated rows of one id and text give as many rows;
rows of one id with different texts are scored apart. Null ids are training documents (their crc32 is null). Without
training tokens N is 0 and all probabilities are those of new tokens. An empty table gives an empty result. Columns
beside the id and the text are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, small_batches, table

ROUNDS = 2
#: Decisions of a subtree, whose weights lie together; the first of them are the class.
LEVELS = 4
CLASS_BITS = LEVELS
#: Least and most decisions on the way to a group, and bits of a weight's slot.
DEPTH = (2 * LEVELS, 3 * LEVELS)
SLOT_BITS = (16, 21)
#: Features that are summed for a decision, and the precision of their weights' prior.
FEATURES = 3
PRIOR = 4.0
#: Tokens that are worked on together, and tokens that are gathered before they are.
STEP = 4096
GATHERED = 65536
HEAVY_SHARE = 200_000
BLOCKS = 64
END = b"\n"  # no word holds a line end
#: Distinct tokens that a worker counts before it hands them on.
COUNTED = 300_000


def tokens(text: str | None) -> list[bytes]:
    return [*text.encode("utf-8", "replace").lower().split(), END] if text else [END]


def hash_of(token: bytes) -> int:
    """64 bits, signed."""
    h = xxhash.xxh64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def groups_of(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Groups of tokens; the first CLASS_BITS bits are the class."""
    return (hashes & np.uint64((1 << depth) - 1)).astype(np.intp)


@dataclass
class Model:
    """total, distinct: N and V of the training tokens. depth: decisions on the way to a group. mass: smoothed counts by group."""

    total: int
    distinct: int
    heavy: np.ndarray  # hashes, sorted
    heavy_logs: np.ndarray  # log10 of their smoothed counts
    depth: int
    mass: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        """Tables with a row for each group: the subtrees of LEVELS decisions on its way (mixed for hashing), the places
        in them, the log odds there and the sides."""
        depth = self.depth
        steps = np.arange(depth, 0, -1)
        leaf = (np.arange(len(self.mass)) + len(self.mass))[:, None]
        self.subtrees = (leaf >> steps[::LEVELS]).astype(np.uint32) * CROSS
        level = np.arange(depth) % LEVELS
        self.places = ((leaf >> steps) & ((1 << level) - 1)) + (1 << level)
        self.side = np.where((leaf >> (steps - 1)) & 1, 1, -1).astype(np.float32)
        self.prior = odds_of(self.mass).take(leaf >> steps)
        self.row_bits = len(self.weights).bit_length() - 1 - LEVELS

    def __getstate__(self) -> dict:
        """Without the tables, which are made from the rest."""
        return {k: v for k, v in vars(self).items() if k not in ("subtrees", "places", "side", "prior")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.__post_init__()


def odds_of(mass: np.ndarray) -> np.ndarray:
    """Log odds of the right side at each place of the tree over groups (a heap: 1 is the root)."""
    sums, level = np.concatenate([np.zeros(len(mass)), mass]), len(mass) // 2
    while level:
        sums[level : 2 * level] = sums[2 * level : 4 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return np.concatenate([[0], np.log(sums[3::2] / sums[2::2])]).astype(np.float32)


CROSS, MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
MULTIPLIERS = np.array([0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def features(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of each token's context features, a row for each feature. first: the tokens' distance from their document's start."""
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    before = [np.where(first >= k, np.concatenate([small[-k:], small[:-k]]), np.uint32(k)) for k in (1, 2)]
    pair = before[0] * np.uint32(0x01000193) + before[1]
    return np.stack([before[0], pair ^ (pair >> np.uint32(16)), before[1]]) * MULTIPLIERS[:, None]


def slots_of(model: Model, context: np.ndarray, subtrees: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Slots of the weights of one feature on the way: tokens x depth. Those of a subtree lie together."""
    x = subtrees + context[:, None]
    x ^= x >> np.uint32(15)
    x *= MIX
    x >>= np.uint32(32 - model.row_bits)
    return ((x.astype(np.intp) << LEVELS)[:, :, None] + places.reshape(*x.shape, LEVELS)).reshape(places.shape)


def chances(model: Model, contexts: np.ndarray, groups: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(slots by feature, odds against the way taken, its side): tokens x depth."""
    subtrees, places = model.subtrees.take(groups, axis=0), model.places.take(groups, axis=0)
    slots = [slots_of(model, c, subtrees, places) for c in contexts]
    z = model.prior.take(groups, axis=0)
    for s in slots:
        z += model.weights.take(s, mode="clip")
    side = model.side.take(groups, axis=0)
    z *= side
    np.clip(z, -40, 40, out=z)  # their product stays below what a double holds
    np.negative(z, out=z)
    return slots, np.exp(z, out=z), side


def path_logs(model: Model, contexts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Natural log of P(class, group | context) of each token."""
    against = chances(model, contexts, groups)[1]
    against += 1
    return -np.log(np.prod(against, axis=1, dtype=np.float64))


def sums(model: Model, contexts: np.ndarray, groups: np.ndarray, into: np.ndarray) -> None:
    """Adds the gradient (real part) and the curvature (imaginary part) of tokens' log likelihood by slot."""
    for k in range(0, len(groups), STEP):
        slots, against, side = chances(model, contexts[:, k : k + STEP], groups[k : k + STEP])
        miss = against / (1 + against)  # the chance of the other side
        both = np.empty(miss.shape, dtype=np.complex64)
        both.real, both.imag = side * miss, miss * (1 - miss)
        for s in slots:
            np.add.at(into, s.ravel(), both.ravel())


def placed(counts: list[int]) -> np.ndarray:
    """Distance of each token from the start of its document."""
    n = np.array(counts)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(hashes_of(list(counts)).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["h", "c"])
        counts.clear()
        return made

    for b in batches:
        for t in b.column(0).to_pylist():
            counts.update(tokens(t))
            if len(counts) >= COUNTED:
                yield out()
    yield out()


def _train(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The task's sums of gradients and curvatures, as BLOCKS rows of bytes."""
    into, words, counts = np.zeros(len(model.weights), dtype=np.complex64), [], []

    def step() -> None:
        h = hashes_of(words)
        sums(model, features(h, placed(counts)), groups_of(h, model.depth), into)
        words.clear(), counts.clear()

    for b in batches:
        for t in b.column(0).to_pylist():
            more = tokens(t)
            words += more
            counts.append(len(more))
            if len(words) >= GATHERED:
                step()
    if words:
        step()
    if into.any():
        parts = np.array_split(into, BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], names=["block", "sums"])


def packed(x: np.ndarray) -> bytes:
    """Sums with 8 bits of fraction: the upper halves of their (rounded) floats."""
    return ((x.view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, dtype=np.uint16).astype(np.uint32) << np.uint32(16)).view(np.complex64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by block of rows (block, sums), as a stream."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(*(b.column(i).to_pylist() for i in range(2))):
            if k in held:
                held[k] += unpacked(raw)
            else:
                held[k] = unpacked(raw).astype(np.complex128)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([x.astype(np.complex64).tobytes() for x in held.values()], pa.binary())], names=["block", "sums"])


def stepped(weights: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A Newton step; all features of a decision step at once, so each takes its part of the way."""
    return (weights + (total.real - PRIOR * weights) / (FEATURES * total.imag.astype(np.float64) + PRIOR)).astype(np.float32)


def bits_for(n: float, least: int, most: int) -> int:
    return min(most, max(least, int(np.ceil(np.log2(max(n, 1))))))


def fit(docs: DataFrame, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """The model and the counts (h, c) of all training tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    training = docs.where(crc.isNull() | (crc % 10 != 0)).select(F.col(text_col).alias("text"), crc.alias("crc"))
    counted = training.select("text").mapInArrow(_count, "h long, c long")
    counts = checkpointed(counted.groupBy("h").agg(F.sum("c").alias("c")))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    often = sorted((r["h"], r["c"]) for r in counts.where(F.col("c") * HEAVY_SHARE >= max(total, 1)).collect())
    heavy, logs = np.array([h for h, _ in often], dtype=np.int64), np.log10(np.array([c for _, c in often], dtype=np.float64) + 0.1)
    depth = LEVELS * -(-bits_for(distinct, *DEPTH) // LEVELS)
    mass = np.full(1 << depth, 0.1)
    group = F.col("h").bitwiseAND(F.lit((1 << depth) - 1)).alias("g")
    for r in counts.groupBy(group).agg(F.sum(F.col("c") + 0.1).alias("m")).collect():  # one row a group
        mass[r["g"]] += r["m"]
    model = Model(total, distinct, heavy, logs, depth, mass, np.zeros(1 << bits_for(4 * distinct, *SLOT_BITS), dtype=np.float32))
    rows = "block int, sums binary"
    for r in range(ROUNDS if total else 0):
        share = training.where((F.coalesce(F.floor(F.col("crc") / 10), F.lit(0)) % ROUNDS) == r).select("text")
        now = Model(total, distinct, heavy[:0], logs[:0], depth, mass, model.weights)
        made = share.mapInArrow(lambda it, m=now: _train(it, m), rows).repartition(BLOCKS, "block").mapInArrow(_summed, rows).collect()
        if made:
            parts = {x["block"]: np.frombuffer(bytes(x["sums"]), dtype=np.complex64) for x in made}
            model.weights = stepped(model.weights, np.concatenate([parts[k] for k in range(BLOCKS)]))
    return model, counts


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """For each document a row of its own, and a row for each distinct token whose count is not at hand."""
    log_mass = np.log10(model.mass)
    names = ["id", "text_hash", "h", "n", "n_tokens", "known", "sum_log", "ways"]
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        start = 0
        while start < len(texts):
            words: list[bytes] = []
            counts: list[int] = []
            marks: list[int] = []
            end = start
            while end < len(texts) and end - start < 4096 and len(words) < 2 * GATHERED:
                more = tokens(texts[end])
                words += more
                counts.append(len(more))
                marks.append(hash_of((texts[end] or "").encode("utf-8", "replace")))
                end += 1
            hashes = hashes_of(words)
            h, groups, contexts = hashes.view(np.int64), groups_of(hashes, model.depth), features(hashes, placed(counts))
            logs = np.concatenate([path_logs(model, contexts[:, k : k + STEP], groups[k : k + STEP]) for k in range(0, len(words), STEP)])
            per = logs / np.log(10) - log_mass.take(groups)
            doc = np.repeat(np.arange(len(counts)), counts)
            if len(model.heavy):
                near = np.minimum(np.searchsorted(model.heavy, h), len(model.heavy) - 1)
                is_heavy, count_logs = model.heavy[near] == h, model.heavy_logs[near]
            else:
                is_heavy, count_logs = np.zeros(len(h), dtype=bool), np.zeros(len(h))
            n = len(counts)
            known = np.bincount(doc, is_heavy, n).astype(np.int64)
            sum_log = np.bincount(doc, np.where(is_heavy, count_logs, 0), n)
            ways = np.bincount(doc, per, n)
            # Distinct rare tokens of each document.
            d, r = doc[~is_heavy], h[~is_heavy]
            order = np.argsort(r, kind="stable")
            order = order[np.argsort(d[order].astype(np.int16), kind="stable")]  # by digits: a batch has few documents
            d, r = d[order], r[order]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])]) if len(d) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.r_[new, len(d)])
            d, r = d[new], r[new]
            row = np.r_[np.arange(n), d]
            mark = np.array(marks, dtype=np.int64)
            own = np.r_[np.ones(n, dtype=bool), np.zeros(len(d), dtype=bool)]
            # A document's own row has a hash that no token need have: it is only to be spread evenly.
            cols = [ids.slice(start, n).take(pa.array(row)), pa.array(mark[row]), pa.array(np.r_[mark, r]), pa.array(np.r_[np.zeros(n, dtype=np.int64), times])]
            extra = [(np.array(counts, dtype=np.int64), np.int64), (known, np.int64), (sum_log, np.float64), (ways, np.float64)]
            cols += [pa.array(np.r_[x, np.zeros(len(d), dtype=t)], mask=~own) for x, t in extra]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            start = end


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score, for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    said = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = said.mapInArrow(lambda it: _score(it, model), f"id {kind}, text_hash long, h long, n long, n_tokens long, known long, sum_log double, ways double")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = F.col("n_tokens").isNull()
    met = rows.join(counts, "h", "left").select(
        "id", "text_hash", "n_tokens", "ways", F.when(rare & (c > 0), F.col("n")).otherwise(F.coalesce("known", F.lit(0))).alias("known"),
        F.when(rare, F.col("n") * F.log10(c + 0.1)).otherwise(F.col("sum_log")).alias("sum_log"))
    each = met.groupBy("id", "text_hash").agg(
        F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").cast("int").alias("copies"), F.sum("known").alias("known"), F.sum("sum_log").alias("sum_log"), F.max("ways").alias("ways"))
    whole = F.col("sum_log") / F.col("copies")
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    norm = float(np.log10(model.total + 0.1 * (model.distinct + 1)))
    return each.select(
        F.col("id").alias(id_col), F.coalesce(crc % 10 == 0, F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (whole - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (whole + F.col("ways")).alias("score"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = fit(docs, "doc_id", "text")
    return score(docs, model, counts)
