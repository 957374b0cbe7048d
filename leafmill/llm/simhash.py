"""SimHash near-duplicates: fingerprints, an exact Hamming-radius join by bit-sliced comparison, and components.

Documents with one fingerprint are one class, so exact copies cost nothing further. Distinct fingerprints meet in
buckets: two that differ in at most `radius` bits agree in at least `parts - radius` of `parts` bit ranges, so a
bucket for each choice of ranges loses no link. The number of parts grows with the number of fingerprints, which keeps
buckets small; every choice is exact. A bucket of more than CHUNK fingerprints is dealt as pairs of chunks. Inside a
bucket bit planes lie vertically, 64 fingerprints to a word; carry-save counters add up many distances at once, and a
word is abandoned as soon as all its 64 distances exceed the radius. What leaves a bucket are links that connect what
all its links do, one fewer than linked fingerprints at most (all of them for FEW or fewer), never all pairs.

similar_texts() links texts whose word shingles are alike by a given share. That share bounds no distance of
fingerprints: at 0.8 two texts differ in some 10 of 64 bits, often in 15 and in more if they are short. So the comparison
by fingerprints, in buckets of min-wise hashes, is its first pass alone, which finds most links and joins groups of near
copies at little cost. A second pass is exact: in one order of all shingles, two texts that are alike share one of each
other's first n - ceil(similarity * n) + 1 of n shingles. Texts of different components of the first pass that share such
a one meet, all with all, if their sizes permit it and the parities of their shingles, counted by bits of the hash,
differ in no more bits than the shingles may. Neither test loses a pair, whatever the order; common shingles (by a
sample, for speed alone) come last in it. Each link of both passes is checked by the exact share of common shingles.

Defined results: a text without words (null, empty, white space) has fingerprint zero and links like any other;
repeated rows stay repeated rows of one class; an empty table gives an empty result. Columns beside the id and the
text are ignored whatever their names. In similar_texts() a text of fewer words than a shingle is one shingle, and texts
without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, small_batches, table
from leafmill.llm.components import components

#: Fingerprints that one task compares all with all, at most (a pair of chunks is twice as many).
CHUNK = 4096
#: Buckets up to this size are compared together, many to a batch; all links of up to FEW fingerprints are given.
SMALL = 128
FEW = 16
#: Planes that are added up before exceeded words are abandoned.
TILE = 8
SEED = 42
#: Rows that may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows that a task of a bucket join should have, at least and at most.
TASK_ROWS = (10_000, 500_000)
#: similar_texts, first pass: texts meet that share the least hashes of all ROWS of one of BANDS. Of pairs that are just
#: 0.8 alike that is 0.998; of pairs that are 0.3 alike, one in thirty. Their fingerprints may differ in WIDE bits.
BANDS = 16
ROWS = 5
WIDE = 18
#: Second pass: texts that common shingles are counted in, in how many of these a shingle is common, and how many are kept.
ORDER_ROWS = 8_000
COMMON = 4
COMMON_KEPT = 100_000
#: Least and most words of 64 parity bits of a text; there are two to four bits for a shingle up to that many.
PARITY_WORDS = (1, 128)
#: Parity words that are compared at once, and pairs that are held before they go out.
COMPARED = 1 << 21
PAIRS = 1 << 19


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Unsigned XXH64 of the word shingles, repeats included; fewer words than `width` are one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z alone, six spaces alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits: a bit is 1 if it is set in over half the hashes."""
    n, total = len(hashes), np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, 1 + n // 65536) if n else ():
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, f"id {kind}, fp long")


# Bit-sliced comparison ------------------------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of bits, lane k of word w being fingerprint 64 * w + k; the last word is filled up with zeros."""
    full = np.zeros(-(-len(fps) // 64) * 64, dtype=np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


class Counters:
    """Vertical counters of set bits, by lane: as many exact planes as the radius needs, and a sticky one above."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.n = [np.zeros(shape, dtype=np.uint64) for _ in range(max(1, radius.bit_length()) + 1)]

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """A carry-save adder takes two planes into the ones; the carry ripples on."""
        n = self.n
        half = n[0] ^ x
        carry = (n[0] & x) | (half & y)
        n[0] = half ^ y
        for k in range(1, len(n) - 1):
            up = n[k] & carry
            n[k] ^= carry
            carry = up
        n[-1] |= carry

    def over(self, radius: int) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        over = self.n[-1].copy()
        equal = ~over
        for k in range(len(self.n) - 2, -1, -1):
            if radius >> k & 1:
                equal &= self.n[k]
            else:
                over |= equal & self.n[k]
                equal &= ~self.n[k]
        return over

    def only(self, keep: np.ndarray) -> None:
        self.n = [x[keep] for x in self.n]


def within(tile, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with lanes within the radius, and these lanes as bits.

    tile(first, last, at) gives the differing planes first..last at the words `at`; valid has the lanes that count.
    """
    at = np.flatnonzero(valid)
    valid = valid[at]
    count = Counters(at.shape, radius)
    for first in range(0, 64, TILE):
        if not len(at):
            break
        x = tile(first, first + TILE, at)
        for k in range(0, TILE, 2):
            count.add(x[k], x[k + 1])
        if (keep := (valid & ~count.over(radius)) != 0).sum() < 0.8 * len(at) or first + TILE == 64:
            at, valid = at[keep], valid[keep]
            count.only(keep)
    return at, valid & ~count.over(radius)


def lanes(at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Numbers of the lanes that are set."""
    word, lane = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return at[word] * 64 + lane


def links_small(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each of many adjacent groups: all fingerprints meet those d places further, for each d."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    index = np.arange(len(fps))
    left = np.repeat(np.cumsum(sizes), sizes) - index  # places to the end of the group
    d = 1
    while len(index := index[left[index] > d]) if d > 1 else len(index):
        # Groups with no pair at this distance are dropped; what stays lies adjacent again.
        size = left[index]
        a, b = planes_of(fps[index]), planes_of(fps[np.minimum(index + d, len(fps) - 1)])
        full = np.zeros(a.shape[1] * 64, dtype=np.uint8)
        full[: len(index)] = size > d
        ok = np.packbits(full, bitorder="little").view("<u8")
        at, bits = within(lambda i, j, w, a=a, b=b: a[i:j, w] ^ b[i:j, w], ok, radius)
        if len(at):
            one = index[lanes(at, bits)]
            found.append((one, one + d))
        d += 1
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))


def links_large(fps: np.ndarray, radius: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group that connect what all its links do; `rows` at a time meet all that follow."""
    root = np.arange(len(fps))
    planes = planes_of(fps)
    words = planes.shape[1]
    lane_ok = np.packbits((np.arange(words * 64) < len(fps)).astype(np.uint8), bitorder="little").view("<u8")
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    found: list[tuple[int, int]] = []
    for start in range(0, len(fps), rows):
        q = fps[start : start + rows]
        flip = np.where((q[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), every, np.uint64(0))
        first = start // 64
        wide = words - first
        valid = np.tile(lane_ok[first:], len(q))
        at, bits = within(lambda i, j, w: planes[i:j, first + w % wide] ^ flip[i:j, w // wide], valid, radius)
        row = at // wide
        for k in np.unique(row):
            mine = row == k
            near = lanes(at[mine] % wide + first, bits[mine])
            met, one = np.unique(root[near], return_index=True)
            own = root[start + k]
            if len(new := one[met != own]):
                found += [(start + int(k), int(x)) for x in near[new]]
                root[np.isin(root, met) | (root == own)] = min(own, met[0])
    return tuple(np.array([x[k] for x in found], dtype=np.int64) for k in (0, 1))


def spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of links that connect what all do: each joins two parts that those before it have not."""
    root: dict[int, int] = {}
    keep = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(k)
    return np.array(keep, dtype=np.int64)


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of nodes from rows (key, fp, node) sorted by key. Holds one group, or a batch of small ones."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def linked(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            own, first = np.unique(node[s : s + n], return_index=True)
            i, j = links_large(fp[s : s + n][first], radius)
            yield out(own[i], own[j])
        small = (sizes > 1) & (sizes <= SMALL)
        few = np.repeat(small, sizes)
        if few.any():
            group, size = node[few], np.repeat(sizes[small], sizes[small])
            i, j = links_small(fp[few], sizes[small], radius)
            many = np.flatnonzero(size[i] > FEW)
            keep = np.r_[np.flatnonzero(size[i] <= FEW), many[spanning(i[many], j[many])]]
            yield out(group[i[keep]], group[j[keep]])

    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for b in batches:
        held.append((b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("node").to_numpy(zero_copy_only=False)))
        n += b.num_rows
        if n < 65536:
            continue
        key, fp, node = (np.concatenate([x[k] for x in held]) for k in range(3))
        if cut := int(np.searchsorted(key, key[-1])):  # the last group may go on in the next batch
            yield from linked(key[:cut], fp[:cut], node[:cut])
        held, n = [(key[cut:], fp[cut:], node[cut:])], len(key) - cut
    if n:
        yield from linked(*(np.concatenate([x[k] for x in held]) for k in range(3)))


def bucket_links(keyed: DataFrame, radius: int, rows: int) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints meet in a bucket (t, v) and differ in at most radius bits, from some
    `rows` rows (t, v, fp, node). Buckets of over CHUNK rows are dealt as pairs of chunks."""
    hot = checkpointed(keyed.groupBy("t", "v").count().where(F.col("count") > CHUNK))
    if hot.isEmpty():
        keyed = keyed.select(F.xxhash64("t", "v").alias("key"), "fp", "node")
    else:
        n = F.ceil(F.col("count") / CHUNK).cast("int")
        own = F.pmod(F.xxhash64("node"), n).cast("int")
        pairs = F.when(n.isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own, j).cast("long") * n + F.greatest(own, j))
        )
        keyed = (
            keyed.join(hot, ["t", "v"], "left")
            .select("t", "v", "fp", "node", F.explode(pairs).alias("pair")).select(F.xxhash64("t", "v", "pair").alias("key"), "fp", "node")
        )
    spread = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = max(1, min(spread, rows // TASK_ROWS[0]), rows // TASK_ROWS[1])
    return keyed.repartition(spread, "key").sortWithinPartitions("key").mapInArrow(lambda it: _edges(it, radius), "a long, b long")


def part_count(distinct: int, radius: int) -> int:
    """Fewest bit ranges with which a bucket of evenly spread fingerprints has about 128 at most."""
    parts = radius + 1
    while distinct / 2 ** (64 * (parts - radius) // parts) > 128 and parts < radius + 4:
        parts += 1
    return parts


def hamming_edges(classes: DataFrame, radius: int, distinct: int) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints of classes (fp) that links of at most radius bits connect."""
    parts = part_count(distinct, radius)
    bounds = [64 * k // parts for k in range(parts + 1)]
    masks = [sum(((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k] for k in chosen) for chosen in combinations(range(parts), parts - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(signed)])
    keyed = classes.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.v")
    return bucket_links(keyed.withColumn("node", F.col("fp")), radius, distinct * len(masks))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint hex, component_id): component_id is the smallest id that links of at most radius bits reach."""
    fps = checkpointed(fingerprints(docs, id_col, text_col, width))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = checkpointed(components(hamming_edges(classes.select("fp"), radius, classes.count())))
    joined = checkpointed(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = checkpointed(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    of = checkpointed(joined.join(least, "root").select("fp", "component_id"))
    return fps.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """Signed hashes of a text's BANDS, each of its number and ROWS least hashes; none have one of their own."""
    least = np.full(len(MULTIPLIERS), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for part in np.array_split(hashes, 1 + len(hashes) // 4096) if len(hashes) else ():
        mixed = part[None, :] * MULTIPLIERS[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    made = [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]
    return [x - (1 << 64) if x >> 63 else x for x in made]


def needed(n: np.ndarray | int, share: Fraction):
    """Shingles that n ones must at least have in common with others to be alike."""
    return -(-share.numerator * n // share.denominator)


def leading(shingles: np.ndarray, share: Fraction, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Those of the distinct shingles, in ascending order, that another text must have one of among its own to be alike.
    The order is by the weight of common ones, then by hash. Texts without words have one of their own."""
    n = len(shingles)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        if (found := common[at] == shingles).any():
            shingles = shingles[np.argsort(np.where(found, weight[at], 0), kind="stable")]
    return shingles[: n - needed(n, share) + 1]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles is odd, for each of so many ranges of the hash's low bits, in words of 64. Where two
    texts differ in a bit they differ in a shingle. Half the words, put on the others by exclusive or, are those of half
    as many ranges."""
    least, most = PARITY_WORDS
    words = min(most, max(least, 1 << max(0, 2 * len(shingles) - 1).bit_length() >> 6))
    odd = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def may_be_alike(key: np.ndarray, root: np.ndarray, size: np.ndarray, parity: list[bytes], share: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one key and different roots that can be alike by their sizes and parities, none being lost.
    Rows are in the order of key and size, so the second of a pair has no fewer words of parities than the first."""
    width = np.array([len(x) // 8 for x in parity])
    place = np.zeros(len(key), dtype=np.int64)
    words: dict[tuple[int, int], np.ndarray] = {}  # those of one width, put together to another
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        place[mine] = np.arange(len(mine))
        x = words[w, w] = np.frombuffer(b"".join(parity[k] for k in mine.tolist()), dtype="<u8").reshape(-1, w)
        for less in (w >> k for k in range(1, w.bit_length())):
            x = words[w, less] = x[:, :less] ^ x[:, less:]
    num, den = share.numerator, share.denominator
    index = np.arange(len(key))
    d = 1
    while len(index := index[index < len(key) - d]):
        # Rows further on in a group are greater, so a row that one is too large for is done.
        index = index[(key[index] == key[index + d]) & (num * size[index + d] <= den * size[index])]
        one = index[root[index] != root[index + d]]
        both = size[one] + size[one + d]
        apart = both - 2 * needed(both, Fraction(num, num + den))
        for w, v in np.unique(np.stack([width[one], width[one + d]], axis=1), axis=0).tolist():
            at = np.flatnonzero((width[one] == w) & (width[one + d] == v))
            for part in np.array_split(at, 1 + len(at) * w // COMPARED):
                a, b = one[part], one[part] + d
                near = np.bitwise_count(words[w, w][place[a]] ^ words[v, w][place[b]]).sum(axis=1, dtype=np.int64) <= apart[part]
                yield a[near], b[near]
        d += 1


def _pairs(batches: Iterator[pa.RecordBatch], share: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that may be alike from rows (key, node, root, size, parity) sorted by key and size."""

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        made = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    def paired(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, root, size = (rows.column(c).to_numpy() for c in ("key", "node", "root", "size"))
        found, n = [], 0
        for i, j in may_be_alike(key, root, size, rows.column("parity").to_pylist(), share):
            found.append(np.sort(np.stack([node[i], node[j]], axis=1), axis=1))
            if (n := n + len(i)) > PAIRS:
                yield out(found)
                found, n = [], 0
        if n:
            yield out(found)

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < 16384:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        if cut := int(np.searchsorted(key, key[-1])):  # the last group may go on in the next batch
            yield from paired(rows.slice(0, cut))
        held, n = rows.slice(cut).to_batches(), len(key) - cut
    if n:
        yield from paired(pa.Table.from_batches(held))


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of some ORDER_ROWS of texts (node, text) have, ascending, and in how many they are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, n = np.unique(np.concatenate([np.unique(shingle_hashes(t, width)) for t in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    some = texts.where(F.pmod("node", F.lit(max(1, texts.count() // ORDER_ROWS))) == 0).dropDuplicates(["node"]).select("text")
    found = some.mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    kept = found.orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).toPandas()
    shingles, n = kept["shingle"].to_numpy(dtype=np.int64).view(np.uint64), kept["n"].to_numpy(dtype=np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def missed_pairs(classes: DataFrame, roots: DataFrame, share: Fraction) -> DataFrame:
    """(a, b): pairs of classes (node, size, leading, parity) of different roots that may be alike, none of those that
    are being lost. Shingles that over CHUNK classes lead with are dealt as pairs of chunks."""
    spread = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    keyed = classes.select("node", "leading").join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("leading").alias("key"))
    # Only what texts of different components share goes on.
    shared = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    shared = checkpointed(shared)
    met = checkpointed(keyed.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "key"))
    n = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = F.when(n <= 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own, j).cast("long") * n + F.greatest(own, j))
    )
    dealt = met.select("node", "root", "key", F.explode(pairs).alias("pair")).select("node", "root", F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"))
    rows = dealt.join(classes.select("node", "size", "parity"), "node")
    spread = max(1, min(spread, met.count() // TASK_ROWS[0]), met.count() // TASK_ROWS[1])
    return rows.select("key", "node", "root", "size", "parity").repartition(spread, "key").sortWithinPartitions("key", "size").mapInArrow(lambda it: _pairs(it, share), "a long, b long")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_hash, component_id, component_hash), a row for each row: texts are linked whose sets of word shingles
    have at least `similarity` of their union in common. The component's id is the smallest that links reach, its hash
    the smallest of that id's texts in the component. Rows without an id are left out."""
    small_batches(docs.sparkSession)
    share = Fraction(str(similarity))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    common, weight = common_shingles(rows.select("node", "text"), width)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, width) for t in b.column(2).to_pylist()]
            distinct = [np.unique(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64)),
                    pa.array([bands(h) for h in hashes], pa.list_(pa.int64())), pa.array([len(h) for h in distinct], pa.int64()),
                    pa.array([leading(h, share, common, weight).view(np.int64) for h in distinct], pa.list_(pa.int64())),
                    pa.array([parities(h).tobytes() for h in distinct], pa.binary()),
                ],
                names=["id", "node", "fp", "bands", "size", "leading", "parity"],
            )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    def alike(near: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are alike, by their shingles."""
        asked = checkpointed(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "first"), "node").select("node", F.col("first").alias("id")))
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
        own = rows.join(asked, ["id", "node"], "left_semi").select("node", "text").mapInArrow(sets, "node long, shingles array<long>")
        own = checkpointed(own.dropDuplicates(["node"]))
        of = lambda name: own.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
        shared, both = F.size(F.array_intersect("of_a", "of_b")).cast("long"), F.size("of_a") + F.size("of_b")
        enough = shared * share.denominator >= (both - shared) * share.numerator
        return checkpointed(near.join(of("a"), "a").join(of("b"), "b").where(enough).select("a", "b"))

    kind = docs.schema[id_col].dataType.simpleString()
    # A class is a distinct text; what is drawn of it is the same for all its rows, so texts need not be dealt anew.
    drawn = rows.mapInArrow(sketches, f"id {kind}, node long, fp long, bands array<long>, size long, leading array<long>, parity binary")
    classes = checkpointed(drawn.groupBy("node").agg(F.min("id").alias("first"), *(F.first(c).alias(c) for c in ("fp", "bands", "size", "leading", "parity"))))
    keyed = classes.select("node", "fp", F.posexplode("bands").alias("t", "v"))
    # Only what shares a bucket with another goes on.
    shared = checkpointed(keyed.groupBy("t", "v").count().where("count > 1").select("t", "v"))
    met = checkpointed(keyed.join(shared, ["t", "v"]))
    edges = alike(checkpointed(bucket_links(met, WIDE, met.count()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    missed = checkpointed(missed_pairs(classes, checkpointed(components(edges)), share).distinct())
    if not missed.isEmpty():
        edges = edges.unionAll(alike(missed))
    roots = checkpointed(components(edges)).withColumnRenamed("node", "own")
    joined = checkpointed(classes.select("node", "first").join(roots, classes["node"] == roots["own"], "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = checkpointed(joined.groupBy("root").agg(F.min(F.struct("first", "node")).alias("least")))
    placed = checkpointed(joined.join(least, "root").select("node", F.col("least.first").alias("component_id"), F.col("least.node").alias("component_hash")))
    return rows.select("id", "node").join(placed, "node").select(F.col("id").alias(id_col), F.col("node").alias("text_hash"), "component_id", "component_hash")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
