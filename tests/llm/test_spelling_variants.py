import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from stratum.llm import spelling_variants as S
from stratum.llm.queries import op12_spelling_variants

LOWER = str.maketrans(S.UPPER, S.LOWER)


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = raw.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    gaps = defaultdict(set)  # a pattern with one place left open, or one letter less
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1:]].add(w)
    near = defaultdict(set)
    for (a, b), group in gaps.items():
        for w in group:
            near[w] |= group - {w}
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def made_up(rng):
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaaa", "ÿÿÿÿÿÿ", "Ångström"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = rng.choice(base[:rng.choice([4, 15, 63])])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "Ä", w[at] * 2]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    chain = "qwertzui " * 160 + "qwertzux " * 30 + "qwertyux " * 5
    return [*rows, (1000, chain), (None, "abcdef " * 30), (7, None), (8, ""), (9, "longest" * 30_000 + " ×÷×÷×÷ " * 50), rows[0], rows[0]]


SIZES = [{}, {"filter_blocks": 128, "chunk_blocks": 64}, {"bits_per_word": 0}]


@pytest.mark.parametrize("sizes", SIZES, ids=["default", "many rounds", "full filters"])
def test_equals_brute_force(spark, docs_of, tmp_path, sizes):
    """Also with many rounds of filters, and with filters that let nearly everything pass."""
    rows = made_up(random.Random(4))
    want = brute(rows)
    if sizes:
        assert found(S.spelling_variants(docs_of(rows), **sizes)) == want
    else:
        docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
        assert found(op12_spelling_variants(spark, str(tmp_path))) == want
    assert any(w[0] for w in want.values()) and any(f and f != r for f, r, *_ in want.values())


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op12_spelling_variants(spark, sf)) == brute(rows)


def test_no_words_and_no_rows(spark, docs_of):
    assert S.spelling_variants(docs_of([(1, "a b c"), (2, None)])).collect() == []
    assert S.spelling_variants(docs_of([])).collect() == []


def test_clashing_columns(spark, docs_of):
    docs = docs_of([(i, "variant variant varient") for i in range(60)])
    more = docs.selectExpr("*", "1 AS word", "2 AS n", "3 AS length", "4 AS raw", "5 AS root")
    assert found(S.spelling_variants(more)) == found(S.spelling_variants(docs))


def test_hashes_of_edits():
    words = ["letter", "abacus", "aabbcc"]
    codes, table = S.codes_of(words, 6), S.place_letter(6)
    h, use = S.deletions(codes, table)
    for r, w in enumerate(words):
        for at in range(6):
            cut = w[:at] + w[at + 1:]
            assert h[r, at] == S.hashes(S.codes_of([cut], 5), S.place_letter(5))[0]
            assert use[r, at] == (at == 0 or w[at] != w[at - 1])
