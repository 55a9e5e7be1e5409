"""Near-duplicate line removal by a deletion-neighbourhood join.

Lines are compared in normal form (lower case, runs of ASCII white space as
one space, ends trimmed).  Two lines are copies if they are equal and not
empty, or if both have at least ``min_chars`` normal characters and their edit
distance (insert, delete, replace) is one.  A line goes if an earlier line is
its copy; earlier means smaller (doc_id, line number).  By default
(``MIN_CHARS``) one edit between shorter lines says nothing, so only equality
counts there; with ``min_chars=1`` all lines that are not empty are compared up
to one edit.  Empty lines always stay.

1. One pass over the texts writes a narrow line table: digest, place, and
   four half keys (of at least ``min_chars`` characters).  Equal lines
   collapse to their earliest place.
2. Lines one edit apart share the first or the last half of the shorter one
   exactly, so a line whose half keys are its own has no other copy.  Lines
   that share a half with a different line are candidates; nothing is lost.
3. Each candidate emits its whole self and every variant with one character
   deleted (where the shared half lets a copy differ), as 64-bit keys with the
   deleted position, in steps of bounded size; time and memory are linear in a
   line (rolling hashes above ``LONG`` characters).  Keys that only one line
   has go.  Lines that differ in one replaced character share a variant at the
   same position; a line with one character more has a variant equal to the
   other line itself.  So each key needs only the earliest line on either
   side: no pairs within a key.
4. Every link (line, earlier line) is verified on the texts.
5. Lines without an earlier copy stay; texts are put together again.

Wherever few rows of a large table are needed by a key, the table first passes
a filter of bounded size: the distinct values of a hash of the keys modulo
2^20, broadcast (``likely``).  It drops most rows that cannot match before they
are shuffled; the exact join follows.

Defined cases: a null text is one empty line and stays null if nothing goes;
null ids come last, ordered by a text hash; rows repeated in id and text are
one document and get the same result; an empty table gives an empty result;
other columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WS, batches_by_bytes, staged, text_or_empty
from .pieces import without_pieces

#: default least length of lines that are compared up to one edit; equal lines go at any length
MIN_CHARS = 32


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), WS, " "))


def _key_columns() -> list[Column]:
    """What names a document: its id and the digest of its text."""
    return [F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("text_hash")]


BUCKETS = 1 << 20


def likely(rows: DataFrame, keys: DataFrame, of_rows: Column, of_keys: Column) -> DataFrame:
    """``rows`` without most of those whose key hash no row of ``keys`` has.

    The broadcast side holds at most BUCKETS integers whatever the data."""
    some = keys.select(F.pmod(of_keys, F.lit(BUCKETS)).cast("int").alias("bucket__")).distinct()
    return (rows.withColumn("bucket__", F.pmod(of_rows, F.lit(BUCKETS)).cast("int"))
            .join(F.broadcast(some), "bucket__", "left_semi").drop("bucket__"))


def lines_of(docs: DataFrame) -> DataFrame:
    """id, text_hash, line_no, line (normal form), one row per line."""
    return (docs.select(*_key_columns(), F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("line_no", "raw"))
            .withColumn("line", normal_line(F.col("raw"))).drop("raw"))


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "line_no")


def _half_keys() -> Column:
    """Keys of the first and last half, as the shorter of two lines one edit apart has them."""
    n = F.length("line")
    keys = []
    for less in (0, 1):
        half = F.floor((n - less) / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), n - less, F.substring("line", F.lit(1), half)),
                 F.xxhash64(F.lit(1), n - less, F.substring("line", n - half + 1, half))]
    return F.array(*keys)


#: strings of more characters get rolling keys: time linear in the line for all its variants
LONG = 1024
#: rows that one step of ``_emit`` holds
STEP = 1 << 16
#: moduli 2^31 - 1, one base and one mixing factor per rolling hash
PRIME = np.uint64((1 << 31) - 1)
BASES = (1103515247, 1664525801, 1299709081)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, int(PRIME))) % PRIME
        done += more
    return out


class Rolling:
    """Keys of a line and of its variants by polynomial hashes, ``STEP`` places at a time.

    With S(i) the sum of (c_j + 1) base^j over j < i, the variant without
    character i has the hash S(i) + (S(n) - S(i + 1)) / base."""

    def __init__(self, line: str):
        self.line = line
        self.powers = [_powers(base, min(len(line), STEP)) for base in BASES]
        self.total = [0] * len(BASES)
        for _, _, after in self._sums():
            self.total = [int(x[-1]) for x in after]

    def _sums(self) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
        """First place of a step, and per hash S(i) and S(i + 1) of its places."""
        sums = [0] * len(BASES)
        for start in range(0, len(self.line), STEP):
            codes = np.frombuffer(self.line[start:start + STEP].encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
            before, after = [], []
            for h, base in enumerate(BASES):
                terms = codes * self.powers[h][:len(codes)] % PRIME * np.uint64(pow(base, start, int(PRIME))) % PRIME
                upto = (np.cumsum(terms) + np.uint64(sums[h])) % PRIME
                before.append(np.concatenate([np.array([sums[h]], np.uint64), upto[:-1]]))
                after.append(upto)
                sums[h] = int(upto[-1])
            yield start, before, after

    @staticmethod
    def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
        return sum(h * m for h, m in zip(hashes, MIX))

    def whole(self) -> np.ndarray:
        return self._mixed([np.array([x], np.uint64) for x in self.total])

    def without(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places, and the keys of the line without the character there."""
        for start, before, after in self._sums():
            hashes = [(b + (np.uint64(total) + PRIME - a) % PRIME * np.uint64(pow(base, -1, int(PRIME)))) % PRIME
                      for b, a, total, base in zip(before, after, self.total, BASES)]
            yield np.arange(start, start + len(before[0])), self._mixed(hashes)


def variant_steps(line: str, front: bool = True, back: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (uint64) and positions in steps of at most ``STEP``: the line itself at -1, then with one
    character deleted, at every position of the first half (``front``) and of the last (``back``).

    The length of a string alone decides how its key is made, so that equal strings have equal keys."""
    n, half = len(line), (len(line) - 1) // 2
    rolling = Rolling(line) if n > LONG else None
    own = rolling.whole() if rolling else np.array([xxhash.xxh3_64_intdigest(line.encode())], np.uint64)
    if n - 1 > LONG:
        yield own, np.array([-1])
        for places, keys in rolling.without():
            use = (front & (places <= n - half)) | (back & (places >= half))
            yield keys[use], places[use]
        return
    places = [i for i in range(n) if (front and i <= n - half) or (back and i >= half)]
    keys = [xxhash.xxh3_64_intdigest((line[:i] + line[i + 1:]).encode()) for i in places]
    yield np.concatenate([own, np.array(keys, np.uint64)]), np.array([-1, *places])


def variants(line: str, front: bool = True, back: bool = True) -> tuple[list[int], list[int]]:
    """All keys and positions of ``variant_steps``."""
    keys, places = zip(*variant_steps(line, front, back))
    return np.concatenate(keys).tolist(), np.concatenate(places).tolist()


@without_pieces
def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1].view(np.int64)),
                                           pa.array(columns[2], pa.int32())], ["no", "key", "at"])

    held, n = [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("no", "line", "front", "back")]
        for i in range(batch.num_rows):
            no, line, front, back = (c[i].as_py() for c in columns)
            for keys, places in variant_steps(line, front, back):
                held.append((np.full(len(keys), no, np.int64), keys, places.astype(np.int32)))
                n += len(keys)
                if n >= STEP:
                    yield rows()
                    held, n = [], 0
    if held:
        yield rows()


@without_pieces
def _one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links whose lines are at most one edit apart, in time linear in the lines."""
    def same(a: str, b: str) -> int:
        """Length of the common prefix."""
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        i = same(a, b)
        return len(b) - len(a) <= 1 and a[i + (len(a) == len(b)):] == b[i + 1:]

    for batch in batches:
        lines, others = batch.column("line"), batch.column("other_line")
        keep = [near(lines[i].as_py(), others[i].as_py()) for i in range(batch.num_rows)]
        yield batch.select(["digest", "other"]).filter(pa.array(keep, pa.bool_()))


def near_links(table: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (digest, other): a line and its earliest verified copy that differs from it and is earlier.

    ``table``: digest, halves of the lines; ``first``: digest, place of every distinct line.
    """
    halves = table.select("digest", F.xxhash64("digest").alias("short"), F.posexplode("halves").alias("side", "half"))
    shared = staged(halves.groupBy("half").agg(F.min("short").alias("a"), F.max("short").alias("b"))
                    .where(F.col("a") != F.col("b")).select("half"), "line-halves")
    found = likely(halves.select("digest", "side", "half"), shared, F.col("half"), F.col("half"))
    # a line that shares its first half can only differ in the last one, and the other way round
    found = staged(found.join(shared, "half", "left_semi").groupBy("digest")
                   .agg(F.max(F.col("side") % 2 == 1).alias("front"), F.max(F.col("side") % 2 == 0).alias("back")),
                   "line-candidate-digests")
    at = staged(likely(first, found, F.xxhash64("digest"), F.xxhash64("digest")).join(found, "digest")
                .select("digest", "place", "front", "back"), "line-candidate-places")
    # the texts of the candidates, from the documents that hold them
    where = at.select(F.col("place.id").alias("c_id"), F.col("place.text_hash").alias("c_hash"),
                      F.col("place.line_no").alias("c_no"))
    holders = likely(docs.select("doc_id", "text"), where, F.xxhash64(text_or_empty()), F.col("c_hash"))
    named = lines_of(holders).join(where, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))
                                   & (F.col("line_no") == F.col("c_no")), "left_semi")
    # rows repeated in id and text hold a line at the same place
    texts = staged(named.select(F.unhex(F.md5("line")).alias("digest"), "line").dropDuplicates(["digest"])
                   .join(at, "digest").withColumn("no", F.monotonically_increasing_id()), "line-candidates")
    keys = staged(texts.select("no", "line", "front", "back").repartition("no")
                  .mapInArrow(_emit, "no long, key long, at int"), "line-variants")
    # of the variants, only keys that two lines have are looked at further
    common = staged(keys.groupBy("key").agg(F.min("no").alias("a"), F.max("no").alias("b"))
                    .where(F.col("a") != F.col("b")).select("key"), "line-keys")
    keys = (likely(keys, common, F.col("key"), F.col("key")).join(common, "key", "left_semi")
            .join(texts.select("no", "digest", "place"), "no"))
    keys = staged(keys.select("key", "at", "digest", "place"), "line-common-variants")

    own = F.col("at") == -1
    # one character replaced: the same variant at the same position
    replaced = keys.where(~own).groupBy("key", "at").agg(
        F.min(F.struct("place", "digest")).alias("early"), F.count(F.lit(1)).alias("n")).where("n > 1")
    replaced = (keys.where(~own).join(replaced, ["key", "at"])
                .where(F.col("early.place") < F.col("place"))
                .select("digest", "place", "early"))
    # one character more: a variant that is the other line itself
    more = keys.groupBy("key").agg(
        F.min(F.when(own, F.struct("place", "digest"))).alias("self"),
        F.min(F.when(~own, F.struct("place", "digest"))).alias("longer")).where("self is not null and longer is not null")
    more = (keys.join(more, "key")
            .withColumn("early", F.when(own, F.col("longer")).otherwise(F.col("self")))
            .where(F.col("early.place") < F.col("place"))
            .select("digest", "place", "early"))
    links = (replaced.unionByName(more).groupBy("digest").agg(F.min("early").alias("early"))
             .select("digest", F.col("early.digest").alias("other")))
    return (links.join(texts.select("digest", "line"), "digest")
            .join(texts.select(F.col("digest").alias("other"), F.col("line").alias("other_line")), "other")
            .select("digest", "line", "other", "other_line").mapInArrow(_one_edit, "digest binary, other binary"))


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, text_hash, drop (line numbers): the documents that lose lines."""
    lines = lines_of(docs)
    # shorter lines have no half keys: they meet equal lines only
    table = staged(lines.where(F.length("line") > 0)
                   .select("id", "text_hash", "line_no", F.unhex(F.md5("line")).alias("digest"),
                           F.when(F.length("line") >= min_chars, _half_keys()).alias("halves")), "lines")
    first = staged(table.groupBy("digest").agg(F.min(_place()).alias("place"),
                                               F.count(F.lit(1)).alias("n")), "line-firsts")
    near = staged(near_links(table.select("digest", "halves"), first, docs), "line-links")
    # a line that goes: not the first of its kind, or the first has an earlier copy
    copies = near.select("digest", F.lit(True).alias("copy"))
    kinds = staged(first.where("n > 1").join(copies, "digest", "left").unionByName(
        first.where("n = 1").join(copies, "digest")).select("digest", "place", "copy"), "line-kinds")
    key = F.xxhash64("digest")
    gone = (likely(table.select("id", "text_hash", "line_no", "digest"), kinds, key, key).join(kinds, "digest")
            .where(F.col("copy") | (_place() != F.col("place"))))
    return (gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
            .withColumnsRenamed({"id": "drop_id", "text_hash": "drop_hash"}))


@F.arrow_udf(StringType())
def _without(texts: pa.Array, drops: pa.Array) -> pa.Array:
    """The texts without some of their lines."""
    out = []
    for text, drop in zip(texts.to_pylist(), drops.to_pylist()):
        if drop:
            gone = set(drop)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pa.array(out, pa.string())


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns ``doc`` (struct of the input row), n_lines, dropped (line numbers), text (what stays)."""
    batches_by_bytes(docs.sparkSession)
    drops = staged(duplicate_lines(docs, min_chars), "line-drops")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_key_columns())
    # documents that surely lose nothing are not shuffled, and their texts stay in the JVM
    buckets = drops.select(F.pmod("drop_hash", F.lit(BUCKETS)).cast("int").alias("bucket__")).distinct()
    rows = rows.withColumn("bucket__", F.pmod("text_hash", F.lit(BUCKETS)).cast("int"))
    text = text_or_empty("doc.text")
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    whole = (rows.join(F.broadcast(buckets), "bucket__", "left_anti")
             .select("doc", n_lines, F.array().cast("array<int>").alias("dropped"), F.col("doc.text").alias("text")))
    joined = (rows.join(F.broadcast(buckets), "bucket__", "left_semi")
              .join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash")), "left")
              .select("doc", n_lines, F.coalesce("drop", F.array().cast("array<int>")).alias("dropped"))
              .withColumn("text", _without(F.col("doc.text"), F.col("dropped"))))
    return whole.unionByName(joined)
