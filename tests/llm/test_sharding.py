import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from stratum.llm.sharding import assign_shards, lpt


def size(text):
    return len((text or "").encode()) + 16


def check(df, rows, n_shards, fine=1024):
    found = assign_shards(df, n_shards, fine).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted(
        (i or -1, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n_shards))
    place = defaultdict(set)
    for r in found:
        place[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    loads = defaultdict(int)
    for r in found:
        loads[r["shard"]] += r["size"]
    return found, [loads[s] for s in range(n_shards)]


def test_equals_plain_lpt_where_every_group_is_an_item(docs_of):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400) + str(i % 250)) for i in range(300)]
    _, loads = check(docs_of(rows), rows, 7)
    groups = defaultdict(int)
    for _, t in rows:
        groups[t] += size(t)
    sizes = sorted(groups.values(), reverse=True)
    want = [0] * 7
    for s, shard in zip(sizes, lpt(sizes, 7)):
        want[shard] += s
    assert sorted(loads) == sorted(want)


def test_bundles_of_small_groups_stay_even(docs_of):
    rng = random.Random(2)
    rows = [(i, "y" * rng.randint(1, 90) + str(i)) for i in range(4000)] + [(9000 + i, "z" * 4000) for i in range(30)]
    _, loads = check(docs_of(rows), rows, 4, fine=16)
    # the group of 30 copies is above a fair share: its shard takes nothing else
    *rest, largest = sorted(loads)
    assert largest == 30 * 4016 > sum(loads) / 4
    assert rest[-1] - rest[0] < 0.05 * sum(rest) / 3


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (None, "a"), (None, "a"), (3, "é" * 10), (3, "é" * 10), (4, "x" * 200000)]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("size", "shard", "digest", "chunk", "n")})
    check(docs, rows, 40)
    assert assign_shards(docs.where("doc_id > 99"), 40).count() == 0


def test_hot_group_is_numbered_in_chunks(docs_of):
    rows = [(i, "one text") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(100)]
    found, loads = check(docs_of(rows), rows, 3)
    assert sorted(loads)[-1] == 3000 * 24


def test_lpt_takes_the_least_loaded():
    assert lpt([9, 7, 6, 5, 5, 4], 3) == [0, 1, 2, 2, 1, 0]
    assert lpt([], 3) == []
