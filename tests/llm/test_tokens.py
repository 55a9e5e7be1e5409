import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratum.llm import pieces as pc
from stratum.llm import sentencepiece_backend as S
from stratum.llm import token_counts as C
from stratum.llm import token_records as R

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [*"abzAZ .,'\n\t 1é ñ!|<>\x01▁", "  ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", " the", "\r\n", "é", "İ", "ß", "Σ",
         "漢", "🙂", " ", "\x85", "　", "\x1c", "\x0b", "<s>", "</s>", "<unk>", "<0x41>", "ǅ", "ﬁ", "½", "²"]
ODD = ["", " ", "   ", "\n", " a", "a ", "a  b", "a   b", "a \n b", "a\n\nb", "x" * 200000, "word " * 30000, "a" + " " * 70000 + "b"]
ODD += [" " * n + s for n in range(1, 40) for s in ("", "the cat")] + ["x" + " " * n + "y" for n in range(1, 40)]


def texts(n=4000):
    rng = random.Random(7)
    return ODD + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def whole(path, t):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]


def test_counts_equal_the_library():
    t = texts()
    assert C.counter(BYTE).counts(pa.array(t)).tolist() == [len(i) for i in whole(BYTE, t)]


def test_ids_equal_the_library():
    t = texts()
    assert [np.frombuffer(i, "<u2").tolist() for i in R.encoder(WORD).encode(pa.array(t))] == whole(WORD, t)


def test_sentencepiece_parity_and_decoding():
    import sentencepiece
    t = texts()
    assert S.parity(t, PIECE) == []
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids, decoded = S.codec(PIECE).run(pa.array(t))
    assert decoded == theirs.decode([np.frombuffer(i, "<u4").tolist() for i in ids])


def test_unigram_and_normaliser_of_a_parsed_model():
    """A unigram model with byte fallback, written as protobuf by hand."""
    import struct

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        size, out = len(value), b""
        while True:
            out += bytes([size & 0x7F | (0x80 if size > 127 else 0)])
            size >>= 7
            if not size:
                return bytes([number << 3 | 2]) + out + value
    vocab = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("c", -5.0, 1), ("abc", -6.0, 1)]
    vocab += [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in vocab)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    model = S.read_model(data)
    assert (model.kind, model.byte_fallback, model.squeeze_spaces, len(model.pieces)) == (S.UNIGRAM, True, True, 263)
    import sentencepiece
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = S.build_tokenizer(model)
    for t in ["ab", "abc", "  ab   c ", "a b c", "é", "abab caé"]:
        assert ours.encode(t).ids == theirs.encode(t), t
        assert ours.decode(ours.encode(t).ids) == theirs.decode(theirs.encode(t))


def test_slices_and_parts():
    lengths = np.array([5, 5, 100, 0, 1, 1])
    assert [(a, b) for a, b in pc.byte_slices(lengths, 10)][0] == (0, 2)
    assert sum(b - a for a, b in pc.byte_slices(lengths, 10)) == 6
    long = "ab cd " * 1000
    parts = pc.safe_parts(long, 100, C.SAFE)
    assert "".join(parts) == long and len(parts) > 50


def test_known_tables_share_one_bound(monkeypatch):
    monkeypatch.setattr(pc.Known, "tables", [])
    known, other = (pc.Known(lambda w: [len(x) for x in w], 10, limit=30) for _ in range(2))
    assert known(["a", "bb"]) == [1, 2] and known(["bb", "ccc", "dddd"]) == [2, 3, 4] and len(known.table) == 3
    assert other(["x"]) == [1] and not known.table  # the room is taken from the other table
    assert other(["x", "yy", "zz", "uu"]) == [1, 2, 2, 2]  # one batch may be above the bound


def test_count_operator_edges(docs_of):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "word " * 3000), (4, "é")]
    docs = docs_of(rows).withColumn("n_tokens", F.lit("clash"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in C.count_tokens(docs, BYTE).collect())
    n = [len(i) for i in whole(BYTE, [t or "" for _, t in rows])]
    assert got == sorted((i or -1, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n))
    assert C.count_tokens(docs.where("doc_id > 9"), BYTE).count() == 0


def test_record_files(spark, docs_of, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6) - 500, f"text {i} " * rng.randint(0, 30)) for i in range(300)] + [(None, None), (None, "n"), (7, ""), (7, "b")]
    manifest = R.write_records(docs_of(rows).withColumn("start", F.lit(0)), WORD, f"file://{tmp_path}/out", file_bytes=4000)
    files = manifest.orderBy("part", "roll").collect()
    assert len(files) > 3 and sum(f["n_records"] for f in files) == len(rows)
    found = R.read_records(manifest, keep_ids=True).orderBy("start").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    want = sorted((i is None, i or 0, w + [1]) for (i, _), w in zip(rows, whole(WORD, [t or "" for _, t in rows])))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in found) == want
    start = 0
    for r in found:
        data = np.array(r["ids"], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(data))
        start += r["n_tokens"]
    first = R.read_record(files[1]["path"], 0)
    k = files[0]["n_records"]
    assert first[0] == found[k]["doc_id"] and first[1].tolist() == found[k]["ids"]


def test_damaged_record_is_found(docs_of, tmp_path):
    manifest = R.write_records(docs_of([(1, "some text")], 1), WORD, f"file://{tmp_path}/out")
    path = manifest.first()["path"][7:] + ".rec"
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        R.read_records(manifest).collect()


def test_no_documents_no_files(docs_of, tmp_path):
    manifest = R.write_records(docs_of([(1, "a")]).where("doc_id > 1"), WORD, f"file://{tmp_path}/out")
    assert manifest.count() == 0 and R.read_records(manifest).count() == 0


def test_encode_decode_edges(docs_of):
    rows = [(1, None), (2, ""), (None, "a  b"), (4, "word " * 3000), (4, "é\n漢 ▁")]
    docs = docs_of(rows).withColumn("n_tokens", F.lit("clash")).withColumn("doc", F.lit(1))
    out = S.encode_decode(docs, PIECE)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "n_tokens", "input_ids", "ids_crc32", "decoded", "round_trip"]
    for r in out.collect():
        assert r["n_tokens"] == len(r["input_ids"]) and r["round_trip"] == ("▁" not in (r["text"] or ""))
    assert S.encode_decode(docs.where("doc_id > 9"), PIECE).count() == 0
