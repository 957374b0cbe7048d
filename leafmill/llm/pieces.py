"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces, and one Viterbi pass.

The automaton reads a text once; at each place its output links give all pieces that end there, longest first, and
each relaxes the best score of that place. The best path is the encoding. Characters in no piece become the pieces of
their bytes. As no piece has a space sign after another character, best paths meet before each space sign: a text is
cut there, and the paths of its units are remembered, which changes no result.

Models that normalise texts (beyond the space signs), have pieces of the user's own or space signs at the ends of words
are refused, as their texts would be encoded otherwise than by the format's own library.

Defined results: a null or empty text has no pieces and decodes to an empty text. Repeated rows each give their row,
an empty table gives none. Texts that hold the space sign U+2581 decode to a space there, as in the file format.
Columns beside the id and the text are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs beyond the least score of a piece.
UNKNOWN_COST = 10.0
#: Units whose paths a worker remembers, in each of two generations: what the older one alone holds goes first.
REMEMBERED = 100_000


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
            yield key >> 3, value
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = number(i)
            yield key >> 3, raw[i : i + n]
            i += n


class Model:
    """Pieces of a model file with their scores and kinds; encodes and decodes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix = True
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model normalises texts in a way that is not supported")
            elif number == 2 and dict(_fields(value)).get(24):
                raise ValueError("the model puts space signs at the ends of words, which is not supported")
        if OWN in self.kinds:
            raise ValueError("the model has pieces that are matched before all others, which is not supported")
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.pieces):
            if self.kinds[k] in (NORMAL, OWN):
                self.automaton.add_word(p, (len(p), self.scores[k], k))
        self.automaton.make_automaton()
        self.worst = min(s for s, kind in zip(self.scores, self.kinds) if kind in (NORMAL, OWN)) - UNKNOWN_COST
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if apart else re.compile(".+", re.S)
        self.known: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}

    def path(self, unit: str) -> tuple[list[int], float]:
        """Ids of the best path through a unit, and its score."""
        n = len(unit)
        best = [0.0] + [-np.inf] * n
        back = [0] * (n + 1)
        piece = [-1] * (n + 1)
        done = 0  # all places up to here have had their pieces
        for end, (length, score, k) in self.automaton.iter(unit):
            end += 1
            while done < end - 1:
                self._settle(best, back, piece, done := done + 1)
            if (total := best[end - length] + score) > best[end]:
                best[end], back[end], piece[end] = total, end - length, k
        while done < n:
            self._settle(best, back, piece, done := done + 1)
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(unit[at - 1].encode("utf-8", "replace"))]
            else:
                ids.append(self.unknown)
            at = back[at]
        return ids[::-1], best[n]

    def _settle(self, best: list[float], back: list[int], piece: list[int], at: int) -> None:
        """Once all pieces that end at a place are known, an unknown character may still be the better way there."""
        if (total := best[at - 1] + self.worst) > best[at]:
            best[at], back[at], piece[at] = total, at - 1, -1

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        """Ids (int32) and the score of the whole text."""
        if not text:
            return np.zeros(0, dtype=np.int32), 0.0
        known, older, parts, score = self.known, self.older, [], 0.0
        for unit in self.units.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)):
            if (hit := known.get(unit)) is None:
                if (hit := older.get(unit)) is None:
                    ids, s = self.path(unit)
                    hit = (array("i", ids).tobytes(), s)
                if len(known) >= REMEMBERED:
                    self.older, self.known = known, {}
                    known, older = self.known, known
                if len(unit) <= 64:
                    known[unit] = hit
            parts.append(hit[0])
            score += hit[1]
        return np.frombuffer(b"".join(parts), dtype=np.int32), score

    def decode(self, ids: np.ndarray) -> str:
        raw = bytearray()
        for k in ids.tolist():
            raw += self.raw(k)
        out = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if self.prefix and out[:1] == " " else out

    @cache  # noqa: B019
    def raw(self, k: int) -> bytes:
        if self.kinds[k] == BYTE:
            return bytes([int(self.pieces[k][3:5], 16)])
        return b"" if self.kinds[k] == CONTROL else self.pieces[k].encode("utf-8")


@cache
def load(path: str) -> Model:
    """One model for each worker process and file."""
    return Model(path)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), score and decoded_sha256 (of the text that the ids decode to), for each row.

    model_path must be readable on each executor.
    """
    small_batches(docs.sparkSession)
    path = model_path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            made = [model.encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) for x, _ in made)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in made)])))
            back = [hashlib.sha256(model.decode(x).encode("utf-8", "replace")).hexdigest() for x, _ in made]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([s for _, s in made], pa.float64()), pa.array(back)], names=["id", "ids", "score", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    said = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return said.mapInArrow(rows, f"id {kind}, ids array<int>, score double, decoded_sha256 string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text, for each row; null ids give an empty text."""
    path = model_path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            texts = [model.decode(np.array(x or [], dtype=np.int32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(rows, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "decoded_sha256")
