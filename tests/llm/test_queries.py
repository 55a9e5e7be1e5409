"""The registered queries on a small table, each against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stratum.llm.queries import ORACLE, QUERIES
from test_bagminhash import brute_classes, near_copy, words
from test_line_dedup import brute as brute_lines


@pytest.fixture(scope="module")
def table(spark, docs_of, tmp_path_factory):
    rng = random.Random(21)
    base = [" ".join(words(rng, rng.randint(20, 90), 3000)) for _ in range(12)]
    rows = []
    for i in range(150):
        lines = [near_copy(rng, rng.choice(base), rng.choice([0, 0, 1, 3])) for _ in range(rng.randint(0, 3))]
        rows.append((i * 3, "\n".join(lines), rng.choice(["a", "a", "a", "b", "c", None])))
    rows += [(900, None, None), (901, "", "b"), (902, "word " * 9000, "a"), (903, "  a \t b ", "c"), (904, " a b ", "c")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs_of(rows).write.parquet(f"{path}/documents.parquet")
    vectors = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)], 0) for i in range(120)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, [(i, t, s) for i, t, s in rows]


def run(spark, table, name):
    return QUERIES[name](spark, table[0]).collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_its_sql(spark, table, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table[0]}/{t}.parquet/*.parquet')")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[n]) for n in names) for r in run(spark, table, name)) == want


def test_op1(spark, table):
    drops = brute_lines([(i, t) for i, t, _ in table[1]])
    found = {r.doc_id: r for r in run(spark, table, "op1_line_dedup")}
    assert len(found) == len(table[1])
    for i, t, _ in table[1]:
        lines, drop = (t or "").split("\n"), drops[i, t]
        kept = "\n".join(x for k, x in enumerate(lines) if k not in drop)
        r = found[i]
        assert (r.n_lines, r.n_dropped, r.dropped) == (len(lines), len(drop), drop)
        assert r.text_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_op4(spark, table):
    ids = {i: e.ids + [1] for (i, _, _), e in zip(table[1], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(
        [t or "" for _, t, _ in table[1]], add_special_tokens=False))}
    start, want = 0, []
    for i in sorted(ids):
        want.append((i, start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    assert sorted(tuple(r) for r in run(spark, table, "op4_token_records")) == want


def test_op6(spark, table):
    n = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([t or "" for _, t, _ in table[1]], add_special_tokens=False)
    want = sorted((i, len((t or "").encode()), len(e.ids), len(e.ids) > 1024) for (i, t, _), e in zip(table[1], n))
    assert sorted(tuple(r) for r in run(spark, table, "op6_token_counts")) == want


def test_op8(spark, table):
    found = {r.doc_id: r for r in run(spark, table, "op8_shards")}
    shard_of, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for i, t, _ in table[1]:
        r, data = found[i], (t or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        shard_of[t or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(len(s) == 1 for s in shard_of.values()) and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, table):
    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in run(spark, table, "op9_sentencepiece")}
    for i, t, _ in table[1]:
        ids, r = theirs.encode(t or ""), found[i]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest() and r.round_trip


def test_op10(spark, table):
    rows = run(spark, table, "op10_near_dedup")
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in rows) == brute_classes([(i, t) for i, t, _ in table[1]])
    assert Counter(r.class_id for r in rows if r.kept) == Counter({r.class_id for r in rows})
