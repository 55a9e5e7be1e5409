"""Spelling variants: words one edit apart, found through Bloom-guided neighbourhoods.

A word is a maximal run of the letters given by ``LETTERS``, with A to Z in lower
case.  Words of at least ``MIN_LENGTH`` letters that occur at least ``MIN_COUNT``
times are the vocabulary.  Two of them are near if one inserted, deleted or
replaced letter makes one of the other.  A word's form is its near word of largest
count (ties: the smallest in code-point order) if that count is at least ``RATIO``
times its own; its root is where the forms lead.

1. One pass counts the words (combined in the map tasks) and keeps the vocabulary.
2. Blocked Bloom filters, one range of 64-bit blocks per word length, are built
   in chunks by tasks and broadcast.  A round's filters hold at most
   ``FILTER_BLOCKS`` blocks (16 MB), whatever the vocabulary: a larger one takes
   more rounds, each with the filters of other lengths or of other chunks.
3. Every word probes its generated edits: all deletions of one letter in the
   filter of the length below, all replacements by a larger letter in its own
   (an insertion or a smaller letter is an edit of the other word).  Hashes are
   sums of a random number per (place, letter), so an edit's hash follows from
   the word's; a probe reads one block.
4. Only edits that hit are shuffled to an exact join with the vocabulary, which
   removes the false positives.  Neighbourhoods are bounded by the word's length
   times the alphabet, so no key of the pairs is hot.
5. Roots by pointer doubling: a form has ``RATIO`` times its word's count, so the
   number of rounds is logarithmic in the logarithm of the largest count.

Defined cases: a null text has no words; a null id counts as the empty string
in the planted typos' hash; rows repeated in id and text count as often as they
occur; texts are read whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters after lower-casing, as code points (all fit in one byte)
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
TYPO_EVERY = 199

BITS_PER_WORD, PROBES = 24, 5
CHUNK_BLOCKS = 1 << 13
FILTER_BLOCKS = 1 << 21
SLICE = 2048


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_letter(places: int) -> np.ndarray:
    """A random number for each place and letter."""
    return mix64(np.arange(places * 256, dtype=np.uint64)).reshape(places, 256)


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def hashes(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(table[np.arange(codes.shape[1]), codes], axis=1)


def masks(h: np.ndarray) -> np.ndarray:
    """The bits of a hash in its block."""
    h = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out = np.zeros_like(h)
    for i in range(PROBES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def block_of(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)).astype(np.int64)


def deletions(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word without the letter at each place, and whether the place counts
    (of a run of equal letters only the first does)."""
    n, length = codes.shape
    at = np.arange(length)
    kept = np.bitwise_xor.accumulate(table[at, codes], axis=1)
    moved = np.bitwise_xor.accumulate(table[np.maximum(at - 1, 0), codes][:, ::-1], axis=1)[:, ::-1]
    zero = np.zeros((n, 1), np.uint64)
    use = np.ones((n, length), bool)
    use[:, 1:] = codes[:, 1:] != codes[:, :-1]
    return np.hstack([zero, kept[:, :-1]]) ^ np.hstack([moved[:, 1:], zero]), use


class Filters:
    """The filters of one round: per length its first block and number of blocks, and which chunks are there."""

    def __init__(self, sizes: dict[int, int], chunks: dict[tuple[int, int], bytes], chunk_blocks: int = CHUNK_BLOCKS):
        self.sizes, self.chunk_blocks, self.starts, self.here, blocks = sizes, chunk_blocks, {}, {}, []
        at = 0
        for length in sorted({k[0] for k in chunks}):
            n = -(-sizes[length] // chunk_blocks)
            self.starts[length] = np.zeros(n, np.int64)
            self.here[length] = np.zeros(n, bool)
            for chunk in range(n):
                if (length, chunk) in chunks:
                    self.starts[length][chunk], self.here[length][chunk] = at, True
                    blocks.append(np.frombuffer(chunks[length, chunk], "<u8"))
                    at += chunk_blocks
        self.blocks = np.concatenate(blocks) if blocks else np.zeros(1, np.uint64)

    def hit(self, length: int, h: np.ndarray) -> np.ndarray:
        """May the vocabulary hold a word of this length and hash, in a chunk of this round?"""
        block = block_of(h, self.sizes[length])
        chunk = block // self.chunk_blocks
        here, start = self.here[length], self.starts[length]
        mask = masks(h)
        found = (self.blocks[start[chunk] + block % self.chunk_blocks] & mask) == mask
        return found if here.all() else found & here[chunk]


def typo_or_word(doc_id: Column, word: Column) -> Column:
    """The word, or without one letter where the hash of id and word says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % TYPO_EVERY == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n, length: the words of the vocabulary, staged."""
    raw = F.col("raw")
    words = (docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("raw"))
             .where(F.length(raw) >= min_length)
             # lower() leaves a run without A-Z or accented capitals as it is
             .withColumn("raw", F.when(F.lower(raw) == raw, raw).otherwise(F.translate(raw, UPPER, LOWER)))
             .select(typo_or_word(F.col("doc_id"), raw).alias("word")))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return staged(counts.where(F.col("n") >= min_count).withColumn("length", F.length("word")), "vocabulary")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Rows and words of each length."""
    words = batch.column("word").to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        for i in range(0, len(rows), SLICE):
            part = rows[i:i + SLICE]
            yield length, part, [words[k] for k in part]


def filter_chunks(words: DataFrame, sizes: dict[int, int], chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """length, chunk, bits: the Bloom filters in chunks, staged."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, part in _by_length(batch):
                h = hashes(codes_of(part, length), place_letter(length))
                block = block_of(h, sizes[length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), length, np.int32)), pa.array((block // chunk_blocks).astype(np.int32)),
                     pa.array((block % chunk_blocks).astype(np.int32)), pa.array(masks(h).view(np.int64))],
                    ["length", "chunk", "block", "mask"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bits = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                                               pa.array([bits.tobytes()], pa.binary())], ["length", "chunk", "bits"])

        for batch in batches:
            length, chunk, block, mask = (batch.column(c).to_numpy() for c in ("length", "chunk", "block", "mask"))
            cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(chunk) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if key != (int(length[a]), int(chunk[a])):
                    if key is not None:
                        yield done()
                    key, bits = (int(length[a]), int(chunk[a])), np.zeros(chunk_blocks, "<u8")
                bits[block[a:b]] |= mask[a:b].view(np.uint64)
        if key is not None:
            yield done()

    schema = "length int, chunk int, block int, mask long"
    # equal places are joined first, so a chunk has at most chunk_blocks rows
    rows = (words.select("word").mapInArrow(placed, schema).groupBy("length", "chunk", "block")
            .agg(F.bit_or("mask").alias("mask")))
    return staged(rows.repartition("length", "chunk").sortWithinPartitions("length", "chunk")
                  .mapInArrow(packed, "length int, chunk int, bits binary"), "bloom-chunks")


def probe(words: DataFrame, filters: Filters) -> DataFrame:
    """source, n, edit: generated edits that the filters let pass."""
    shared = words.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shared.value.starts
        for batch in batches:
            counts = batch.column("n")
            for length, rows, part in _by_length(batch):
                codes, table = codes_of(part, length), place_letter(length)
                found_rows, found = [], []
                if length - 1 in has:
                    h, use = deletions(codes, table)
                    hit = shared.value.hit(length - 1, h.ravel()).reshape(h.shape) & use
                    for r, at in zip(*(x.tolist() for x in np.nonzero(hit))):
                        found_rows.append(r)
                        found.append(part[r][:at] + part[r][at + 1:])
                if length in has:
                    own = hashes(codes, table)
                    for at in range(length):
                        other = (own ^ table[at, codes[:, at]])[:, None] ^ table[at, ALPHABET][None, :]
                        r, k = np.nonzero(ALPHABET[None, :] > codes[:, at][:, None])
                        hit = shared.value.hit(length, other[r, k])
                        for row, letter in zip(r[hit].tolist(), ALPHABET[k[hit]].tolist()):
                            found_rows.append(row)
                            found.append(part[row][:at] + chr(letter) + part[row][at + 1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[r] for r in found_rows], pa.string()),
                     counts.take(pa.array(rows[np.array(found_rows, np.int64)])), pa.array(found, pa.string())],
                    ["source", "source_n", "edit"])

    return words.select("word", "n").mapInArrow(run, "source string, source_n long, edit string")


def rounds_of(sizes: dict[int, int], filter_blocks: int, chunk_blocks: int) -> list[list[tuple[int, int]]]:
    """The chunks (length, chunk) of each round."""
    chunks = [(length, c) for length in sorted(sizes) for c in range(-(-sizes[length] // chunk_blocks))]
    each = max(1, filter_blocks // chunk_blocks)
    return [chunks[i:i + each] for i in range(0, len(chunks), each)]


def near_pairs(words: DataFrame, bits_per_word: int = BITS_PER_WORD, filter_blocks: int = FILTER_BLOCKS,
               chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """word, n, near, near_n: both directions of all pairs one edit apart.

    The three sizes set the filters' precision and memory; the result does not depend on them."""
    spark = words.sparkSession
    # word lengths in use: few, as a length needs MIN_COUNT words of it; not more rows than the longest word has letters
    counts = words.groupBy("length").agg(F.count(F.lit(1)).alias("words")).collect()
    sizes = {r["length"]: max(1, r["words"] * bits_per_word // 64) for r in counts}
    chunks = filter_chunks(words, sizes, chunk_blocks)
    found = None
    for some in rounds_of(sizes, filter_blocks, chunk_blocks):
        wanted = spark.createDataFrame(some, "length int, chunk int")
        bits = {(r["length"], r["chunk"]): bytes(r["bits"])
                for r in chunks.join(F.broadcast(wanted), ["length", "chunk"], "left_semi").collect()}
        passed = probe(words, Filters(sizes, bits, chunk_blocks))
        exact = passed.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
        pairs = staged(exact.select("source", "source_n", "edit", "edit_n"), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    return found.select(F.inline(F.array(
        F.struct(F.col("source").alias("word"), F.col("source_n").alias("n"), F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
        F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("source").alias("near"), F.col("source_n").alias("near_n")))))


def roots(forms: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, root of all words with a form.  ``forms``: word, form, n."""
    now = staged(forms.select("word", F.col("form").alias("root")), "word-roots")
    largest = forms.agg(F.max("form_n")).first()[0] or 1
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log(largest, ratio)))))):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "word-roots")
    return now


def spelling_variants(docs: DataFrame, ratio: int = RATIO, **sizes: int) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.  ``sizes``: of the filters."""
    words = vocabulary(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = staged(near_pairs(words, **sizes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near-best")
    form_n = -F.col("best.less")
    linked = words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= ratio * F.col("n"), F.col("best.form")).alias("form"),
        F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n"))
    linked = staged(linked, "word-forms")
    ends = roots(linked.where("form is not null"), ratio)
    return linked.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
