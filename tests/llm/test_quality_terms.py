"""The classifier's terms: the same as word by word, without an object or a hash per shape, nothing kept."""
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash

from stratum.llm import pieces
from stratum.llm import quality_knn as Q

ROWS = ["The cat, the", "", "  ", None, "ΑΣ ΟΔΟΣ, ΣΑΣ σας Straße ǅ", "İstanbul I ı 12٣½ x1Y2z3", "a\tb\nc\x0bd\x0c e\r f",
        "no break　wide  line", "中文 字 🙂🙂 é é", "THE the THE the", "w w w w", *[f"Word{i} x{i}" for i in range(150)]]


def plain(text, terms):
    """Word by word."""
    out = np.zeros(terms, np.float32)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    for w in words:
        shape = ""
        for c in w:
            kind = unicodedata.category(c)
            sign = {"Ll": "a", "Lu": "A"}.get(kind, "0" if kind[0] == "N" else "")
            shape += "" if sign and shape.endswith("\0" + sign) else ("\0" + sign if sign else c)
        shape = shape.replace("\0", "")
        for h in (xxhash.xxh3_64_intdigest("w" + w.lower()), xxhash.xxh3_64_intdigest("s" + shape)):
            out[(h & 0xFFFFFFFF) % terms] += 1
    if words:
        again = sum(w in words[max(0, i - Q.LAGS):i] for i, w in enumerate(words))
        out[xxhash.xxh3_64_intdigest(f"r{int(10 * (again / len(words)))}") % terms] += len(words)
    return out


def test_terms_are_those_of_each_word(monkeypatch):
    monkeypatch.setattr(Q, "PART_WORDS", 7)
    texts = pa.array([t or "" for t in ROWS])
    for terms in (64, Q.TERMS):
        want = np.array([plain(t or "", terms) for t in ROWS])
        assert (Q.term_counts(texts, terms) == want).all()
        assert (Q.term_counts(texts.slice(4, 7), terms) == want[4:11]).all()
        parts = list(Q.blocks(texts, terms))
        assert max(j - i for _, _, i, j in parts) <= Q.SLICE_ROWS
        assert (np.concatenate([some.counts(i, j) for some, _, i, j in parts]) == want).all()
        assert (np.concatenate([some.held(i, j) for some, _, i, j in parts]) == (want > 0)).all()
    assert Q.term_counts(pa.array([], pa.string()), 64).shape == (0, 64)


def test_words_of_a_slice_are_hashed_once_and_shapes_once(monkeypatch):
    calls = []
    real = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(Q.xxhash, "xxh3_64_intdigest", lambda s: calls.append(s) or real(s))
    texts = pa.array([f"Once again word{i % 50} Word{i % 50}, of {i % 10}" for i in range(300)])
    n = sum(j - i for some, _, i, j in Q.blocks(texts))
    assert n == 300
    # 50 + 50 + 10 + 3 words and their 5 shapes, in one slice of five blocks
    assert len([c for c in calls if c[0] == "w"]) <= 113 and len([c for c in calls if c[0] == "s"]) <= 5


def test_nothing_is_kept_in_the_process():
    pieces.Known.release()
    rng = np.random.default_rng(3)
    model = Q.KnnModel(np.ones(256, np.float32), rng.standard_normal((256, 4)).astype(np.float32),
                       rng.standard_normal((9, 4)).astype(np.float32), np.ones(9, np.float32), 0.5, 3)
    assert len(model.scores(pa.array([f"word{i} other{i}" for i in range(500)]))) == 500
    assert not any(len(t.table) for t in pieces.Known.tables)
