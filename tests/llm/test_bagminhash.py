import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratum.llm import bagminhash as B


def bag(text):
    words = (text or "").split()
    n = max(1, len(words) - 4) if words else 0
    return Counter(tuple(words[i:i + 5]) for i in range(n))


def jaccard(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def brute_classes(rows):
    """Class id per row: connected components over all pairs."""
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and jaccard(bags[i], bags[j]) >= 0.8:
                label[find(i)] = find(j)
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    out = Counter()
    for ids in members.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, min(known) if known else None, len(ids)] += 1
    return out


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def near_copy(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
    return " ".join(w)


def classes(df):
    rows = df.collect()
    per_class = Counter((r["class_id"], r["class_size"]) for r in rows if r["kept"])
    assert sum(per_class.values()) == len({(r["class_id"], r["class_size"]) for r in rows}) or None in {r["class_id"] for r in rows}
    return Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows)


def test_shingles_and_bags_match_plain_python():
    texts = ["", "  ", "one", "a b c d", "a b c d e", " a\tb\nc  d e f ", "x x x x x x x x x", None, "é ß 漢 🙂 ñ ü"]
    values, counts, offsets = B.bags(pa.array([t or "" for t in texts], pa.string()))
    for i, t in enumerate(texts):
        assert sorted(counts[offsets[i]:offsets[i + 1]].tolist()) == sorted(bag(t).values())
    whole, ends = B.shingles(pa.array(["a b c d e f"]))
    assert len(whole) == 2 and ends.tolist() == [0, 2]


def test_signature_estimates_weighted_jaccard():
    rng = random.Random(5)
    for weights in ((1, 1), (1, 9), (1, 40)):
        a = {rng.getrandbits(60): rng.randint(*weights) for _ in range(150)}
        b = {k: max(1, v + rng.randint(-3, 3)) if weights[1] > 1 else v for k, v in list(a.items())[:110]}
        b |= {rng.getrandbits(60): rng.randint(*weights) for _ in range(40)}
        truth = jaccard(Counter(a), Counter(b))
        sides = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        m = 4096
        sig = B.signatures(np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]),
                           np.array([0, len(a), len(a) + len(b)]), m)
        assert abs((sig[0] == sig[1]).mean() - truth) < 4 * (truth * (1 - truth) / m) ** 0.5 + 0.005
        assert B.overlap(*sides) == pytest.approx(truth)


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g", "h i j k l m n o p", "", "q", "a b c d e f g"]
    together = B.signatures(*B.bags(pa.array(texts)))
    for t, row in zip(texts, together):
        assert (B.signatures(*B.bags(pa.array([t])))[0] == row).all()


def test_classes_match_brute_force(docs_of):
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(6):
        base = " ".join(words(rng, rng.randint(60, 150)))
        for edits in (0, 0, 1, 1, 2, 3, 4, 12):
            rows.append((n, near_copy(rng, base, edits)))
            n += 1
    rows += [(n + i, " ".join(words(rng, 80))) for i in range(10)]
    rng.shuffle(rows)
    assert classes(B.near_dedup(docs_of(rows))) == brute_classes(rows)


def test_shared_passage_and_a_hot_group(docs_of):
    """Many documents share half their words without being copies; a large group of near copies."""
    rng = random.Random(12)
    passage = " ".join(words(rng, 60, 5000))
    rows = [(i, passage + " " + " ".join(words(rng, 40, 5000))) for i in range(60)]
    base = " ".join(words(rng, 120, 5000))
    rows += [(100 + i, near_copy(rng, base, 2)) for i in range(80)]
    rows += [(200 + i, base) for i in range(60)]
    assert classes(B.near_dedup(docs_of(rows))) == brute_classes(rows)


def test_links_between_members_that_miss_the_first(docs_of):
    """A chain: neighbours are near copies, the ends are not."""
    rng = random.Random(13)
    w = words(rng, 200, 9999)
    rows = []
    for i in range(8):
        rows.append((i, " ".join(w)))
        at = 10 + i * 22
        w = w[:at] + ["new%d_%d" % (i, j) for j in range(14)] + w[at + 14:]
    want = brute_classes(rows)
    assert len({c for _, c, _ in want}) == 1
    assert classes(B.near_dedup(docs_of(rows))) == want


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "one two three"), (5, "one two three"), (6, "one two"), (7, "a a a a a a a a"),
            (8, "a a a a a a a a a"), (None, "only null"), (9, "x " * 30000), (10, "x " * 29000)]
    assert classes(B.near_dedup(docs_of(rows))) == brute_classes(rows)
    assert B.near_dedup(docs_of(rows).where("doc_id > 99")).count() == 0


def test_one_row_of_each_class_stays(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([(1, text), (1, text), (2, text + " more"), (3, "else"), (3, "else"), (4, None)]).withColumn("class", F.lit("c"))
    stay = sorted((r["doc_id"], r["class"]) for r in B.drop_near_copies(docs).collect())
    assert stay == [(1, "c"), (3, "c"), (4, "c")]
