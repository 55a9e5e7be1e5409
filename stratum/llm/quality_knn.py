"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

1. Every text becomes hashed term counts: its words in lower case, and their
   shapes (runs of lower-case letters, capitals and digits as one character,
   other characters as they are), and once per word the tenth in which the
   text's share of recently repeated words lies.
2. Document frequencies of the hashed terms are counted over all documents.
3. The labelled sample: at most ``sample`` labelled rows in the order of a
   hash of their ids (a documented bound on what the classifier learns from).
   Its tf-idf matrix gives a truncated singular value decomposition, whose
   right vectors project every text to a unit vector of ``rank`` dimensions.
4. The projection and the labelled vectors (both bounded by ``sample``,
   ``terms`` and ``rank``, 2 MB with the defaults) are broadcast.  Every
   document's cosines to all labelled vectors are computed exactly, block by
   block, and its ``k`` nearest neighbours vote, weighted by similarity.

A text's score depends on the text alone.

Defined cases: a null text is the empty text; a text whose vector is zero (no
known term), or without a neighbour of positive similarity, gets the share of
good labels in the sample; without labelled rows every score is 1; null labels
teach nothing, labels repeated for an id count as the smallest; null and
repeated ids are kept as they are; an empty table gives an empty result;
other columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, staged
from .pieces import byte_slices, utf8_lengths, without_pieces

SAMPLE, TERMS, RANK, NEIGHBOURS = 4096, 4096, 64, 9
KEEP = 0.7
LAGS = 16
SLICE_ROWS = 64
SLICE_TEXT = 1 << 20
PART_WORDS = 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def repeated_share(codes: np.ndarray, row: np.ndarray, n_rows: int, lags: int = LAGS) -> np.ndarray:
    """Per row, the share of its words that equal one of the ``lags`` words before."""
    again = np.zeros(len(codes), bool)
    for lag in range(1, min(lags, len(codes) - 1) + 1):
        again[lag:] |= (codes[lag:] == codes[:-lag]) & (row[lag:] == row[:-lag])
    n = np.maximum(np.bincount(row, minlength=n_rows), 1)
    return np.bincount(row, weights=again, minlength=n_rows) / n


def _hashes(pieces: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)) & np.uint64(0xFFFFFFFF)


def word_terms(words: pa.Array, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed terms of words without ASCII white space: of each in lower case, and of its shape.

    The words go through as one string per part, cut at its spaces: no object per word outlives a part."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(words), PART_WORDS):
        part = words.slice(at, PART_WORDS)
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")
        shapes = line
        for pattern, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
            shapes = pc.replace_substring_regex(shapes, pattern, sign)
        low = ("w" + line[0].as_py().lower().replace(" ", " w")).split(" ")
        kinds = pc.split_pattern(shapes, " ").flatten().dictionary_encode()
        of_kind = _hashes(["s" + s for s in kinds.dictionary.to_pylist()])
        found.append(tuple((h % np.uint64(terms)).astype(np.int64)
                           for h in (_hashes(low), of_kind[kinds.indices.to_numpy(zero_copy_only=False)])))
    return tuple(np.concatenate(x) for x in zip(*found))


class Terms:
    """The hashed terms of some texts; counts of any rows of them, which are dense, are made block by block."""

    def __init__(self, texts: pa.Array, terms: int = TERMS):
        self.terms, self.n_rows = terms, len(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(self.n_rows), np.diff(offsets))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]
        self.row, self.codes = row[real], codes[real]
        self.ends = np.searchsorted(self.row, np.arange(self.n_rows + 1))
        self.of_word = word_terms(coded.dictionary, terms)
        self.of_tenth = np.array([xxhash.xxh3_64_intdigest(f"r{i}") % terms for i in range(11)])

    def _block(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows a to b: each word's row, its code, and each row's term of repeated words."""
        i, j = self.ends[a], self.ends[b]
        row, codes = self.row[i:j] - a, self.codes[i:j]
        tenth = (10 * repeated_share(codes, row, b - a)).astype(np.int64)
        return row, codes, self.of_tenth[tenth]

    def counts(self, a: int, b: int) -> np.ndarray:
        """Term counts, a row per text."""
        row, codes, tenth = self._block(a, b)
        counts = np.zeros((b - a) * self.terms, np.float32)
        for bucket in self.of_word:
            counts += np.bincount(row * self.terms + bucket[codes], minlength=len(counts)).astype(np.float32)
        counts = counts.reshape(b - a, self.terms)
        counts[np.arange(b - a), tenth] += np.bincount(row, minlength=b - a)
        return counts

    def held(self, a: int, b: int) -> np.ndarray:
        """Which terms each text holds."""
        row, codes, tenth = self._block(a, b)
        held = np.zeros((b - a, self.terms), bool)
        for bucket in self.of_word:
            held[row, bucket[codes]] = True
        some = np.diff(self.ends[a:b + 1]) > 0
        held[np.flatnonzero(some), tenth[some]] = True
        return held


def term_counts(texts: pa.Array, terms: int = TERMS) -> np.ndarray:
    """Hashed term counts, a row per text."""
    return Terms(texts, terms).counts(0, len(texts))


def blocks(texts: pa.Array, terms: int = TERMS) -> Iterator[tuple[Terms, int, int, int]]:
    """The terms of about SLICE_TEXT bytes of the texts at a time, the place of their first row,
    and the rows of them that one dense block takes."""
    for a, b in byte_slices(utf8_lengths(texts), SLICE_TEXT):
        some = Terms(texts.slice(a, b - a), terms)
        for i in range(0, b - a, SLICE_ROWS):
            yield some, a, i, min(b - a, i + SLICE_ROWS)


def document_frequencies(docs: DataFrame, terms: int = TERMS) -> tuple[np.ndarray, int]:
    """How many documents hold each hashed term, and how many there are."""
    @without_pieces
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(terms, np.int64), 0
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for some, _, i, j in blocks(texts, terms):
                total += some.held(i, j).sum(axis=0)
            n += len(texts)
        found = np.append(np.flatnonzero(total), terms)  # the last one counts documents
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.append(total, n)[found])], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(terms + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:terms], int(out[terms])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of at most ``sample`` labelled documents."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("label")))
    chosen = staged(known.join(docs.select("doc_id"), "doc_id", "left_semi")
                    .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
                    .withColumnsRenamed({"doc_id": "l_id"}), "labelled")

    @without_pieces
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for some, a, i, j in blocks(texts, terms):
                packed = [(np.flatnonzero(c).astype("<i4").tobytes(), c[c > 0].astype("<f4").tobytes())
                          for c in some.counts(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("l_id").slice(a + i, j - i), batch.column("label").slice(a + i, j - i),
                     *[pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1)]],
                    ["l_id", "label", "terms", "counts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
            .select("l_id", F.col("label").cast("int").alias("label"), "text")
            .mapInArrow(run, f"l_id {id_type}, label int, terms binary, counts binary")
            .dropDuplicates(["l_id"]).orderBy("l_id").collect())
    counts, marks = np.zeros((len(rows), terms), np.float32), np.zeros(len(rows), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["terms"], "<i4")] = np.frombuffer(r["counts"], "<f4")
        marks[i] = r["label"] == 1
    return counts, marks


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


def right_vectors(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """The ``rank`` leading right singular vectors, by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return np.ascontiguousarray(basis @ turn[:rank].T)


@dataclass
class KnnModel:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int

    def tfidf(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(counts) * self.idf)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score per text, block by block."""
        if not len(self.labels):
            return np.ones(len(texts))
        return np.concatenate([np.zeros(0), *[self._votes(some.counts(i, j))
                                              for some, _, i, j in blocks(texts, len(self.idf))]])

    def _votes(self, counts: np.ndarray) -> np.ndarray:
        latent = unit_rows(self.tfidf(counts) @ self.projection)
        cosine = latent @ self.vectors.T
        k = min(self.k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.divide(vote, total, out=np.full(len(counts), self.prior), where=total > 1e-9), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, rank: int = RANK,
        k: int = NEIGHBOURS) -> KnnModel:
    batches_by_bytes(docs.sparkSession)
    counts, marks = labelled_sample(docs, labels, sample, terms)
    df, n = document_frequencies(docs, terms)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
    model = KnnModel(idf, np.zeros((terms, 0), np.float32), np.zeros((0, 0), np.float32), marks,
                     float(marks.mean()) if len(marks) else 1.0, k)
    if len(marks):
        x = model.tfidf(counts)
        model.projection = right_vectors(x, rank)
        model.vectors = unit_rows(x @ model.projection)
    return model


def score(docs: DataFrame, model: KnnModel) -> DataFrame:
    """Columns ``doc`` (struct of the input row) and score."""
    batches_by_bytes(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @without_pieces
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("doc").field("text"), "")
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(shared.value.scores(texts))], ["doc", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")
