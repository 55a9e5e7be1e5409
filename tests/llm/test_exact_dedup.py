import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from stratum.llm.exact_dedup import exact_dedup, mg_merge


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for j, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out[i, keep, len(ids), j == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def run(df, **kw):
    return Counter(tuple(r) for r in exact_dedup(df, **kw).collect())


def test_matches_brute_force_with_few_counters(docs_of):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "warm text", f"own {i}", f"some {i % 40}", " some  1", "some\t1", "some 1 "])) for i in range(1500)]
    for counters in (1, 5, 1024):
        assert run(docs_of(rows), counters=counters) == brute(rows)


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\t"), (None, "a"), (6, "a"), (None, "n"), (None, "n"), (9, "x" * 300000), (8, "x" * 300000),
            (7, "é b"), (5, "é b")]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("kept", "digest", "_row", "win")})
    assert run(docs) == brute(rows)
    assert exact_dedup(docs.where("doc_id > 99")).count() == 0


def test_repeated_rows_keep_one(docs_of):
    assert run(docs_of([(1, "a"), (1, "a"), (1, "b")])) == brute([(1, "a"), (1, "a"), (1, "b")])


def test_summary_names_every_frequent_value():
    rng = random.Random(2)
    for k in (3, 10):
        stream = [rng.choice([0, 0, 0, 1, 1, *range(2, 60)]) for _ in range(4000)]
        counts = {}
        for i in range(0, len(stream), 100):
            counts = mg_merge(counts, Counter(stream[i:i + 100]), k)
        assert len(counts) <= k
        for v, n in Counter(stream).items():
            assert counts.get(v, 0) >= n - len(stream) / (k + 1) and counts.get(v, 0) <= n
