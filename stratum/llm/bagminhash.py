"""MinHash near-dedup of multisets with BagMinHash signatures.

A document is the multiset of its five-word shingles (words: runs of
characters that are not ASCII white space).  Two documents are near copies if
their weighted Jaccard similarity, sum of the smaller over sum of the larger
multiplicities, is at least 0.8.

Signature.  Every shingle owns a Poisson process over weights, seeded by the
shingle alone and discretised at whole multiplicities.  Its axis is cut into
dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ..., an independent process
each.  A point has a time, one of the signature's positions and a level in its
interval; a shingle of multiplicity w uses the points below w, so intervals
above w are never opened.  Position k keeps its earliest point.  Equal values
then have probability equal to the weighted Jaccard similarity, for every
position: the estimate is unbiased.  Points are made in time order, and a
process stops as soon as its next point is later than the document's latest
position, so most shingles cost one or two points.

Search.  Documents with equal multisets collapse first (hot groups by the
heavy-hitter split of exact dedup).  Signatures are banded (24 bands of 5: a
pair at 0.8 is missed with probability 7e-5, no setting depends on the data).
In each band bucket

1. every member is paired with one document of the bucket (another one in each
   band, so a group of near copies gets many hubs) and the multiset overlap of
   the pair is verified on the texts;
2. what step 1 leaves open is settled exactly.  In buckets whose members are
   not all in one class, each member that is not a near copy of the hub is
   compared with every member that still can be one of its near copies:
   1 - similarity is a metric, so a member at distance s from the hub can be
   near one at distance t only if t - s <= 0.2.  The comparison runs in blocks
   of bounded bytes, as a product of membership matrices that gives the exact
   multiset overlaps, and returns only links that join different classes.

Classes are the connected components of the verified links, found by
alternating large-star and small-star rounds on tables in the shared folder.

Defined cases: a null text is the empty text; a text of one to four words is
one shingle of those words; texts without words form one class; null ids come
last, and a class's id is its smallest doc_id (null if all are); of rows
repeated in id and text exactly one is kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, staged, text_or_empty
from .exact_dedup import resolve_groups
from .line_dedup import BUCKETS, likely
from .pieces import byte_slices, utf8_lengths, without_pieces

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
M = BANDS * ROWS
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
COLUMNS = 8192
PAIRS_PER_COPY = 256
#: Bytes of text whose shingles a task works on at once (their arrays take a multiple of it).
PART_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _MULT
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in one array, and the rows' offsets in it."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    words = coded.dictionary.to_pylist()
    hashes = _word_hashes(words)[coded.indices.to_numpy(zero_copy_only=False)]
    if "" in words:  # the empty text splits into one empty word
        real = coded.indices.to_numpy(zero_copy_only=False) != words.index("")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        hashes = hashes[real]
    n_words = np.diff(offsets)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(ends[-1]) - ends[row] + offsets[row]
    width = np.minimum(n_words[row], SHINGLE)
    out = mix64(width.astype(np.uint64))
    for i in range(SHINGLE):
        has = width > i
        step = mix64(out ^ hashes[np.minimum(at + i, len(hashes) - 1)]) if len(hashes) else out
        out = np.where(has, step, out)
    return out, ends


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row (sorted), their multiplicities, and the rows' offsets."""
    values, ends = shingles(texts)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(values)))
    return values[starts], counts, np.searchsorted(row[starts], np.arange(len(ends)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / (1 << 53)


def signatures(values: np.ndarray, counts: np.ndarray, offsets: np.ndarray, m: int = M) -> np.ndarray:
    """One row of ``m`` 32-bit values per bag (zeros for an empty bag)."""
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    best = np.full(n_rows * m, np.inf)
    mark = np.zeros(n_rows * m, np.uint32)
    # one process per shingle and dyadic interval below its multiplicity
    reach = np.ceil(np.log2(counts)).astype(np.int64) + 1 if len(counts) else counts
    which = np.repeat(np.arange(len(values)), reach)
    level = np.arange(len(which)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    row, weight = row[which], counts[which]
    state = mix64(values[which] ^ mix64(level.astype(np.uint64)))
    time = np.zeros(len(which))
    while len(row):
        state = mix64(state)
        time = time - np.log(_unit(state)) / (width * m)
        latest = best.reshape(n_rows, m).max(axis=1)
        go = time < latest[row]
        row, weight, low, width, state, time = (x[go] for x in (row, weight, low, width, state, time))
        place = mix64(state ^ np.uint64(0x5851F42D4C957F2D))
        slot = row * m + (place % np.uint64(m)).astype(np.int64)
        depth = low + ((place >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
        used = (depth < weight) & (time < best[slot])
        slots, times = slot[used], time[used]
        names = (mix64(state[used] ^ depth[used].astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        np.minimum.at(best, slots, times)
        won = best[slots] == times
        mark[slots[won]] = names[won]
    return mark.reshape(n_rows, m)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted values, multiplicities)."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common) if total > common else 1.0


@without_pieces
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in byte_slices(utf8_lengths(texts), PART_BYTES):
            values, counts, offsets = bags(texts.slice(a, b - a))
            marks = signatures(values, counts, offsets)
            digests = [hashlib.blake2b(values[i:j].tobytes() + counts[i:j].tobytes(), digest_size=16).digest()
                       for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a),
                 pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in marks.astype("<u4")], pa.binary())],
                ["doc_id", "text_hash", "digest", "signature"])


@without_pieces
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, BANDS, ROWS)
        key = mix64(np.broadcast_to(np.arange(BANDS, dtype=np.uint64), marks.shape[:2]))
        for i in range(ROWS):
            key = mix64(key ^ marks[:, :, i].astype(np.uint64))
        rows = np.repeat(np.arange(len(marks)), BANDS)
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)),
                                          pa.array(key.ravel().view(np.int64))], ["node", "band"])


@without_pieces
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in byte_slices(sum(utf8_lengths(batch.column(c)) for c in ("text_a", "text_b")), PART_BYTES):
            part = batch.slice(a, b - a)
            both = []
            for name in ("text_a", "text_b"):
                coded = part.column(name).dictionary_encode()
                values, counts, offsets = bags(coded.dictionary)
                own = [(values[i:j], counts[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
                both.append([own[k] for k in coded.indices.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array([overlap(x, y) for x, y in zip(*both)], pa.float64())],
                ["a", "b", "similarity"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs``: a, b, distinct.  Adds their similarity.  ``texts``: node, text.

    A document in many pairs (a hub, the b side) is copied once per PAIRS_PER_COPY of
    them, and its pairs are dealt over the copies.
    """
    # staged: a join of two scans is one whose hot hubs Spark can split
    copies = staged(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_COPY).cast("int").alias("copies")),
                    "pair-copies")
    dealt = (pairs.join(copies, "b")
             .withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies"))
    right = (texts.join(copies.withColumnRenamed("b", "node"), "node")
             .select(F.col("node").alias("b"), F.col("text").alias("text_b"),
                     F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return (dealt.join(left, "a").join(right, ["b", "copy"])
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(_verified, "a long, b long, similarity double"))


@without_pieces
def _itemised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset as a sorted set of 64-bit items: the c-th copy of a shingle is an item of its own."""
    for batch in batches:
        for a, b in byte_slices(utf8_lengths(batch.column("text")), PART_BYTES):
            values, counts, offsets = bags(batch.column("text").slice(a, b - a))
            copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            items = np.where(copy > 0, mix64(np.repeat(values, counts) ^ mix64(copy.astype(np.uint64))), np.repeat(values, counts))
            ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(a, b - a),
                 pa.array([np.sort(items[i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())],
                ["node", "items"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the item sets of two blocks."""
    of_a, of_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b))
    shared = np.intersect1d(of_a, of_b)
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for items, row in ((of_a, row_a), (of_b, row_b)):
        at = np.searchsorted(shared, items)
        hit = np.zeros(len(items), bool)
        inside = at < len(shared)
        hit[inside] = shared[at[inside]] == items[inside]
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], row[hit][order]))
    for first in range(0, len(shared), COLUMNS):
        parts = []
        for (at, row), n in zip(sides, (len(a), len(b))):
            i, j = np.searchsorted(at, (first, first + COLUMNS))
            member = np.zeros((n, COLUMNS), np.float32)
            member[row[i:j], at[i:j] - first] = 1
            parts.append(member)
        out += parts[0] @ parts[1].T
    return out


@without_pieces
def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: a block of open members and a block of members of one bucket.  Yields
    links that join different classes, none that follows from others of its row."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            (an, ac, ai), (bn, bc, bi) = (
                (np.array([m["node"] for m in r[s]], np.int64), np.array([m["class"] for m in r[s]], np.int64),
                 [np.frombuffer(m["items"], np.uint64) for m in r[s]]) for s in ("open", "other"))
            common = overlaps(ai, bi)
            total = np.array([len(x) for x in ai])[:, None] + np.array([len(x) for x in bi])[None, :] - common
            i, j = np.nonzero((common >= SIMILARITY * total) & (ac[:, None] != bc[None, :]))
            _, keep = np.unique(np.stack([ac[i], bc[j]]), axis=1, return_index=True)
            label: dict[int, int] = {}

            def root(c: int) -> int:
                while label.get(c, c) != c:
                    c = label[c]
                return c
            found = []
            for x, y in zip(i[keep], j[keep]):
                cx, cy = root(int(ac[x])), root(int(bc[y]))
                if cx != cy:
                    label[max(cx, cy)] = min(cx, cy)
                    found.append((int(an[x]), int(bn[y])))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([max(f) for f in found]), pa.array([min(f) for f in found])], ["a", "b"])


def components(links: DataFrame, name: str = "classes") -> DataFrame:
    """node, class (the smallest node reachable) of all nodes in ``links`` (a, b)."""
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # large star: larger neighbours of a node join the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .where("a > b").distinct())
        large = staged(large, name)
        # small star: smaller neighbours of a node, and the node, join the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(least.select("a", F.col("least").alias("b"))).where("a > b").distinct())
        after = staged(small, name)
        sums = [e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first() for e in (edges, after)]
        edges = after
        if sums[0] == sums[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("class"))


def near_links(nodes: DataFrame, texts_of) -> DataFrame:
    """Verified links a, b between ``nodes`` (node, signature).

    ``texts_of``: gives node, text for a table of nodes.
    """
    bands = staged(nodes.mapInArrow(_banded, "node long, band long"), "bands")
    # the hub of a bucket: the smallest node after mixing with the bucket's key
    shared = (bands.groupBy("band").agg(F.min(F.col("node").bitwiseXOR(F.col("band"))).alias("hub"),
                                        F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("band", F.col("hub").bitwiseXOR(F.col("band")).alias("hub")))
    members = staged(bands.join(shared, "band"), "band-members")
    texts = staged(texts_of(members.select("node").distinct()), "member-texts")
    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    tested = staged(verify(staged(pairs, "pairs"), texts), "pair-similarity")
    links = tested.where(F.col("similarity") >= SIMILARITY).select("a", "b")
    classes = components(links)

    # buckets with members of different classes, some not near copies of the hub
    scored = (members.join(tested.select(F.col("a").alias("node"), F.col("b").alias("hub"), "similarity"),
                           ["node", "hub"], "left")
              .join(classes, "node", "left")
              .select("band", "node", F.coalesce("class", "node").alias("class"),
                      (1 - F.coalesce("similarity", F.lit(1.0))).alias("distance")))
    scored = staged(scored, "band-scored")
    unmatched = F.col("distance") > 1 - SIMILARITY
    stats = (scored.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"),
                                        F.min(F.when(unmatched, F.col("distance"))).alias("nearest"))
             .where("nearest is not null and lo <> hi").select("band", "nearest"))
    # of the matched members, those far enough from the hub to reach an unmatched one
    live = (scored.join(stats, "band")
            .where(unmatched | (F.col("distance") >= F.col("nearest") - (1 - SIMILARITY) - 1e-9)))
    live = staged(live, "band-live")
    items = staged(texts.join(live.select("node").distinct(), "node", "left_semi")
                   .mapInArrow(_itemised, "node long, items binary"), "member-items")
    # a bucket is cut into blocks of bounded size; the salt keeps it out of one task
    weights = items.select("node", F.greatest(F.octet_length("items") / BLOCK_BYTES, F.lit(1 / BLOCK_ROWS)).alias("weight"))
    live = live.join(weights, "node")
    salts = live.groupBy("band").agg(F.ceil(F.sum("weight") / 16).cast("long").alias("salts"))
    filled = F.sum("weight").over(Window.partitionBy("band", "salt").orderBy("node")
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    member = F.struct("node", "class", "items")
    # staged, as rows that are dealt by band already would be grouped by (band, salt) where they are;
    # without the items, which a member has in each of its bands: they come in on the way into the blocks
    salted = staged(live.join(salts, "band").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).drop("salts"),
                    "band-salted").join(items, "node")
    blocks = (salted.repartition("band", "salt").withColumn("block", F.floor(filled - 1e-9))
              .groupBy("band", "salt", "block")
              .agg(F.collect_list(F.when(unmatched, member)).alias("open"), F.collect_list(member).alias("other")))
    blocks = staged(blocks, "band-blocks")
    compared = (blocks.where(F.size("open") > 0).select("band", "open")
                .join(blocks.select("band", "other"), "band"))
    return links.unionByName(compared.mapInArrow(_close_pairs, "a long, b long").distinct())


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, class_id, class_size, kept."""
    batches_by_bytes(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = staged(rows.mapInArrow(_signed, f"doc_id {id_type}, text_hash long, digest binary, signature binary")
                    .withColumn("_row", F.monotonically_increasing_id()), "signatures")
    resolved = staged(resolve_groups(signed.select("doc_id", "digest", "_row")), "equal-bags")
    # one node per distinct multiset: the row of its smallest doc_id
    places = signed.select(F.col("_row").alias("node"), "doc_id", "text_hash", "signature")
    nodes = staged(places.join(resolved.where("kept").select(F.col("_row").alias("node"), "group_size"), "node"), "nodes")

    def texts_of(some: DataFrame) -> DataFrame:
        at = staged(nodes.join(some, "node").select("node", F.col("doc_id").alias("at_id"),
                                                    F.col("text_hash").alias("at_hash")), "node-places")
        # texts that surely are no node's are not shuffled
        return (likely(rows, at, F.col("text_hash"), F.col("at_hash")).join(at, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash")))
                .select("node", "text").dropDuplicates(["node"]))

    links = staged(near_links(nodes.select("node", "signature"), texts_of), "near-links")
    classes = staged(nodes.select("node", "doc_id", "group_size").join(components(links), "node", "left")
                     .withColumn("class", F.coalesce("class", "node")), "node-classes")
    best = classes.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("win"),
        F.sum("group_size").alias("class_size"))
    of_node = (classes.select("node", "class").join(best, "class")
               .select(F.col("node").alias("keep_row"), F.col("win.doc_id").alias("class_id"), "class_size",
                       F.col("win.node").alias("class_row")))
    return (resolved.select("_row", "keep_row").join(of_node, "keep_row")
            .join(signed.select("_row", "doc_id", "text_hash"), "_row")
            .select("doc_id", "text_hash", "class_id", "class_size", (F.col("_row") == F.col("class_row")).alias("kept")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class."""
    marked = staged(near_dedup(docs).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "kept"), "near-kept")
    # documents in no bucket of a lost one stay, and are not shuffled
    lost = F.broadcast(marked.where("not kept").select(F.pmod("k_hash", F.lit(BUCKETS)).cast("int").alias("bucket__")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id",
                       F.xxhash64(text_or_empty()).alias("text_hash"))
    rows = rows.withColumn("bucket__", F.pmod("text_hash", F.lit(BUCKETS)).cast("int"))
    clean, rest = rows.join(lost, "bucket__", "left_anti"), rows.join(lost, "bucket__", "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    kept = marked.where("kept").withColumn("bucket__", F.pmod("k_hash", F.lit(BUCKETS)).cast("int"))
    found = rest.join(kept.join(lost, "bucket__", "left_semi").drop("bucket__"), same, "left_semi")
    # rows repeated in id and text: one stays
    repeats = staged(rest.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                     .select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")), "repeats")
    if not repeats.isEmpty():
        found = found.join(repeats, same, "left_anti").unionByName(
            found.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return clean.select("doc.*").unionByName(found.select("doc.*"))
