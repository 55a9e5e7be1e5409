import random
import re

import pytest
from pyspark.sql import functions as F

from stratum.llm.line_dedup import MIN_CHARS, line_dedup, variants


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def brute(rows, least=MIN_CHARS):
    """Dropped lines per (id, text): every pair of lines is compared."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = {}, {}
    for doc_id, text in docs:
        drop = []
        for i, line in enumerate((text or "").split("\n")):
            x = norm(line)
            if x and (x in seen or (len(x) >= least and any(within_one(x, y) for y in seen if len(y) >= least))):
                drop.append(i)
            if x:
                seen[x] = True
        out[doc_id, text] = drop
    return out


def result(df):
    return {(r["doc"]["doc_id"], r["doc"]["text"]): (r["dropped"], r["text"], r["n_lines"]) for r in df.collect()}


def check(docs_of, rows, least=MIN_CHARS):
    got, want = result(line_dedup(docs_of(rows), least)), brute(rows, least)
    assert set(got) == set(want)
    for key, drop in want.items():
        dropped, text, n_lines = got[key]
        assert dropped == drop, key
        lines = (key[1] or "").split("\n")
        assert n_lines == len(lines)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in drop)
        assert text == (key[1] if not drop else kept)


def edit(rng, line):
    i = rng.randrange(len(line) + 1)
    return rng.choice([line[:i] + "q" + line[i:], line[:i] + line[i + 1:], line[:i] + "z" + line[i + 1:]])


@pytest.mark.parametrize("least", [1, 2, 5, 32])
def test_any_least_length(docs_of, least):
    """1 is the exact form: all lines that are not empty are compared up to one edit."""
    rng = random.Random(least)
    rows = [(i, "\n".join("".join(rng.choices("ab ", k=rng.choice([0, 1, 2, 3, 4, 7, 12, 33]))) for _ in range(3)))
            for i in range(60)]
    check(docs_of, rows, least)


def test_matches_brute_force(docs_of):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc d") for _ in range(rng.randint(30, 60))).strip() for _ in range(12)]
    rows = []
    for doc_id in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                line = edit(rng, line)
            lines.append(rng.choice([line, line.upper(), "  " + line.replace(" ", "\t")]))
        rows.append((doc_id, "\n".join(lines)))
    check(docs_of, rows)


def test_runs_and_positions(docs_of):
    a = "a" * 40
    b = "the same long line of words is here"
    check(docs_of, [(1, a), (2, a + "a"), (3, "a" * 39), (4, "a" * 37), (5, "b" + a[1:]), (6, a[:20] + "b" + a[21:]),
                    (7, b), (8, "x" + b), (9, b + "y"), (10, "xx" + b), (11, b[1:]), (12, b[:-1]), (13, "xz" + b + "y")])


def test_edges(docs_of):
    line = "one long enough line that repeats a lot"
    rows = [(None, line), (None, line + "!"), (3, None), (4, ""), (5, line), (6, "\n\n" + line + "\n\n"), (7, "short\nshort"),
            (8, "é" * 50), (9, "é" * 49 + "e"), (10, line + "\n" + line), (11, "🙂" * 33), (12, "🙂" * 34)]
    check(docs_of, rows)


def test_repeated_rows_get_one_result(docs_of):
    line = "one long enough line that repeats a lot"
    got = line_dedup(docs_of([(1, line), (1, line), (2, line)])).collect()
    assert sorted((r["doc"]["doc_id"], r["dropped"]) for r in got) == [(1, []), (1, []), (2, [0])]


def test_long_text(docs_of):
    lines = [f"line number {i * i} of a very long document" for i in range(5000)]
    got = result(line_dedup(docs_of([(1, "\n".join(lines)), (2, "\n".join(reversed(lines)))])))
    assert all(text == "" and len(drop) == 5000 for (i, _), (drop, text, _) in got.items() if i == 2)


def test_empty_and_clashing_columns(spark, docs_of):
    assert line_dedup(docs_of([(1, "a")]).where("doc_id > 5")).count() == 0
    docs = docs_of([(1, "a\nb")]).withColumns({c: F.lit(c) for c in ("id", "drop", "doc", "line", "text_hash", "drop_id", "dropped")})
    row = line_dedup(docs).first()
    assert row["doc"]["drop"] == "drop" and row["text"] == "a\nb"


def test_variants():
    keys, places = variants("abca")
    assert len(keys) == len(places) == 5 and places[0] == -1
