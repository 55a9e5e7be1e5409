import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from stratum.llm.mixing import mix, sample_mix, source_targets


def md5_32(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(sizes):
    """Targets by resharing the excess until no source is above three times its size."""
    target, free, left = {}, dict(sizes), sum(sizes.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if 3 * sizes[s] < level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= 3 * free.pop(s)
    return target


def brute(rows, seed="mix-1"):
    """Size, source size, target and copies of each row, by one prefix sum per source."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total, members = Counter(), defaultdict(list)
    for i, (_, _, source) in enumerate(rows):
        total[source] += size[i]
        members[source].append(i)
    target, out = fill(total), [None] * len(rows)
    for source, own in members.items():
        own.sort(key=lambda i: (size[i], md5_32("" if rows[i][0] is None else str(rows[i][0])), rows[i][0] is None, rows[i][0] or 0))
        shift = md5_32(seed + ":" + ("1" if source is None else "0" + source)) % 65536 / 65536
        rate = target[source] / total[source] if total[source] else 0.0
        for p, i in enumerate(own, 1):
            out[i] = {"size": size[i], "source_size": total[source], "target": target[source],
                      "copies": math.floor(p * rate + shift) - math.floor((p - 1) * rate + shift)}
    return out


def rows_of(n, sources):
    return [(i, "w " * (i * 7 % 50), sources[i * i % len(sources)]) for i in range(n)]


def check(docs_of, rows):
    got = Counter((r["doc"]["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"])
                  for r in mix(docs_of(rows)).collect())
    assert got == Counter((row[0], w["size"], w["source_size"], round(w["target"], 6), w["copies"])
                          for row, w in zip(rows, brute(rows)))


@pytest.mark.parametrize("sources", [["a", "b", "c", "d", None], ["only"], ["hot"] * 30 + ["b", "é", "𝄞", "ﬀ"], ["A", "a", ""]])
def test_matches_one_prefix_sum(docs_of, sources):
    check(docs_of, rows_of(600, sources))


def test_hot_run_is_cut_and_stays_exact(docs_of):
    rows = [(i, "same size text", "hot") for i in range(3000)] + rows_of(300, ["b", "c"])
    check(docs_of, rows)


def test_targets_near_and_no_more_than_three(docs_of):
    rows = rows_of(1500, ["a"] * 9 + ["b", "c", "d"])
    taken, targets, largest = Counter(), {}, Counter()
    for r in mix(docs_of(rows)).collect():
        assert 0 <= r["copies"] <= 3
        source = r["doc"]["source"]
        taken[source] += r["copies"] * r["size"]
        targets[source] = r["target"]
        largest[source] = max(largest[source], r["size"])
    assert all(abs(taken[s] - t) <= largest[s] + 1 for s, t in targets.items())
    assert sum(targets.values()) == pytest.approx(sum(len(t.split()) for _, t, _ in rows))


def test_edges(docs_of):
    check(docs_of, [(None, None, None), (1, "", "empty"), (2, None, "empty"), (3, "a b", "s"), (4, "w " * 90000, "s"), (None, "c", "s")])
    assert mix(docs_of([(1, "a", "s")]).where("doc_id > 1")).count() == 0
    check(docs_of, [(1, "", "a"), (2, "", "b")])


def test_repeated_rows_and_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    docs = docs_of([(1, "a b c", "s")] * 5 + [(2, "d", "t")]).withColumns({c: F.lit(c) for c in ("size", "copies", "src", "doc", "part", "rank")})
    found = mix(docs).collect()
    assert len(found) == 6 and {r["doc"]["size"] for r in found} == {"size"}
    assert sample_mix(docs).columns == docs.columns


def test_reruns_agree(docs_of):
    rows = rows_of(500, ["a", "b"])
    a, b = (sorted((r["doc"]["doc_id"], r["copies"]) for r in mix(docs_of(rows, n)).collect()) for n in (2, 5))
    assert a == b


def test_levels(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 0, "e": 400}
    df = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
    got = {r["src"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(fill(sizes))
