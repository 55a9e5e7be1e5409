"""Short lines: equal ones go at any length, one edit counts from 32 characters on."""
from test_line_dedup import norm, result, within_one

from stratum.llm.line_dedup import line_dedup


def brute(rows):
    """Dropped lines per (id, text), by a rule of its own: no constant of the operator."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = [], {}
    for doc_id, text in docs:
        drop = []
        for i, line in enumerate((text or "").split("\n")):
            x = norm(line)
            if any(x == y or (min(len(x), len(y)) >= 32 and within_one(x, y)) for y in seen):
                drop.append(i)
            if x:
                seen.append(x)
        out[doc_id, text] = drop
    return out


def test_short_repeats_go(docs_of):
    licence = "released under the mit license."
    assert len(licence) == 31
    rows = [(1, licence + "\nx\n\n \nown words"), (2, "All  rights reserved.\n" + licence.upper() + "\nX"),
            (3, "\n" + licence + "\nall rights reserved.\n\ny"), (4, licence[:-1] + "\n" + licence + "s"),
            (5, licence + "s\n" + licence + "t\n" + licence[:-1] + ","), (6, "é\né\nÉ"), (None, "x\nall rights reserved")]
    want = brute(rows)
    got = {key: drop for key, (drop, _, _) in result(line_dedup(docs_of(rows))).items()}
    assert got == want
    assert want[rows[1]] == [1, 2] and want[rows[2]] == [1, 2] and want[rows[3]] == [] and want[rows[4]] == [0, 1]


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {key: drop for key, (drop, _, _) in result(line_dedup(docs)).items()}
    assert got == brute(rows)
    lines = {key: (key[1] or "").split("\n") for key in got}
    assert any(0 < len(norm(lines[key][i])) < 32 for key, drop in got.items() for i in drop)
