import struct

import sentencepiece

from leafmill.llm.pieces import Model, _fields, decode, default_path, encode


def number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def unigram_file(path):
    """The same pieces as a unigram model, which the library searches by scores. Runs of spaces get scores that its
    32-bit sums can hold."""
    field = lambda k, v: number(k << 3 | 2) + number(len(v)) + v
    out = b""
    with open(default_path(), "rb") as f:
        for k, v in _fields(f.read()):
            if k == 1:
                p = dict(_fields(v))
                score = struct.unpack("<f", p[2])[0]
                score = score if score > -1e8 else -40000.0 - 7 * len(p[1])
                out += field(1, field(1, p[1]) + number(2 << 3 | 5) + struct.pack("<f", score) + number(3 << 3) + number(p.get(3, 1)))
    out += field(2, number(3 << 3) + number(1) + number(35 << 3) + number(1))
    out += field(3, field(1, b"identity") + b"".join(number(k << 3) + number(v) for k, v in ((3, 1), (4, 0), (5, 1))))
    path.write_bytes(out)
    return str(path)


def test_viterbi_is_the_librarys(spark, tmp_path):
    path = unigram_file(tmp_path / "unigram.model")
    model, library = Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    lines = [x[:120] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for x in r[0].split("\n")[:3]]
    for line in [*lines, "a  b   c", "日本語 \U0001f600x", "   ", "https://x.y/z?q=1", "\ttab"]:
        assert model.encode(line)[0].tolist() == library.encode(line), line


def test_round_trip(spark, odd, nothing):
    made = encode(odd)
    back = decode(made).collect()
    want = sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == want
    assert encode(nothing).count() == 0
