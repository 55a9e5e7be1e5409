"""Repair of conversation structure at the least cost, with an audit of the edits.

The rows of a conversation are taken by turn (nulls first; rows of one turn by
role, then by a digest of the text).  A row's first fault counts: blank (only
ASCII white space), duplicate (role and text seen earlier in the conversation),
truncated (its last character that is no white space is none of ``.!?``).

Edits, in the order of rows: Keep (0), Rerole to user or assistant (1), Delete
(2; blank and duplicate rows must go), Insert an empty user or assistant row
(5, anywhere); a truncated row that stays adds 5.  The initials of the roles
that result must read ``(s?(ua)+)?``.  Of all cheapest edit sequences the one
whose initials are least in ASCII order is the audit.

1. Equal rows of a turn collapse to one row with a count.  Earlier rows with the
   same role and text come from an aggregate, so no window over a conversation.
2. The rows are sorted by range over the whole table.  Every 4,096 places are
   a segment, so a conversation of any length is spread over tasks.
3. Persistent audit DP.  A segment's pieces of conversations are solved for each
   state in which a piece can be entered.  Edit prefixes are linked nodes that
   share what they have in common, with binary-lifting ancestors and rolling
   hashes.  Equal costs are decided by the longest common prefix: below the
   lowest common ancestor it is found by binary search on prefix hashes, and
   the text it covers is compared, so a hash collision cannot decide.
   (A proper prefix never ties: the longer one would hold more inserts.)
4. A conversation's pieces are joined by the same nodes, a piece's audit each.
5. The audits and the rows are streamed in order to write the repaired text.

Steps 4 and 5 stream a conversation through one task, as its audit is one
string and its digest is a chain; no step holds the texts of a conversation.

Defined cases: null roles and texts count as one space, null conversation ids
are one conversation; a role that is empty or whose first character is none of
``sua`` cannot be kept; repeated rows are duplicates; a conversation without
rows has zeros, the empty audit and the digest of the empty string; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged

WHITE = " \t\n\x0b\x0c\r"
SEGMENT_BITS = 12

#: states: nothing yet, after system, after user, after assistant
STATES = range(4)
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

MOD, BASE = (1 << 61) - 1, 0x1F0E3A5B7C9D


class Prefix:
    """An edit prefix: a piece of text after another prefix."""

    __slots__ = ("text", "length", "depth", "hash", "ups", "mark")

    def __init__(self, before: Prefix | None, text: str):
        self.text, self.ups = text, []
        if before is None:
            self.length, self.depth, self.hash = len(text), 0, piece_hash(0, text)
            return
        self.length, self.depth = before.length + len(text), before.depth + 1
        self.hash = piece_hash(before.hash, text)
        up, k = before, 0
        while up is not None:
            self.ups.append(up)
            up, k = (up.ups[k] if k < len(up.ups) else None), k + 1

    def upto(self, length: int) -> int:
        """Hash of the first ``length`` characters."""
        node = self
        for k in range(len(self.ups) - 1, -1, -1):
            if k < len(node.ups) and node.ups[k].length >= length:
                node = node.ups[k]
        while node.ups and node.ups[0].length >= length:
            node = node.ups[0]
        start = node.ups[0] if node.ups else None
        if start is None:
            return piece_hash(0, node.text[:length])
        return piece_hash(start.hash, node.text[:length - start.length])

    def since(self, start: int, end: int | None = None) -> str:
        """The characters from ``start`` to ``end``."""
        parts, node = [], self
        while node is not None and node.length > start:
            parts.append(node.text)
            first, node = node.length - len(node.text), node.ups[0] if node.ups else None
        whole = "".join(reversed(parts))
        return whole[start - first:None if end is None else end - first] if parts else ""

    def nodes(self) -> list[Prefix]:
        out, node = [], self
        while node is not None:
            out.append(node)
            node = node.ups[0] if node.ups else None
        return out[::-1]


def piece_hash(before: int, text: str) -> int:
    for c in text:
        before = (before * BASE + ord(c)) % MOD
    return before


def shared(a: Prefix, b: Prefix) -> int:
    """Length of the lowest common ancestor of two prefixes."""
    if a.depth < b.depth:
        a, b = b, a
    for k in range(len(a.ups) - 1, -1, -1):
        if k < len(a.ups) and a.ups[k].depth >= b.depth:
            a = a.ups[k]
    if a is b:
        return a.length
    for k in range(len(a.ups) - 1, -1, -1):
        if k < len(a.ups) and k < len(b.ups) and a.ups[k] is not b.ups[k]:
            a, b = a.ups[k], b.ups[k]
    return a.ups[0].length if a.ups and b.ups and a.ups[0] is b.ups[0] else 0


def less(a: Prefix, b: Prefix) -> bool:
    """Is the text of ``a`` before that of ``b``?"""
    if a is b:
        return False
    base = low = shared(a, b)
    high = min(a.length, b.length)
    while low < high:
        mid = (low + high + 1) // 2
        if a.upto(mid) == b.upto(mid):
            low = mid
        else:
            high = mid - 1
    x, y = a.since(base, low + 1), b.since(base, low + 1)
    return x < y  # equal up to the last character, unless two hashes collided: then an earlier one decides


def better(a: tuple[int, Prefix], b: tuple[int, Prefix] | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and less(a[1], b[1]))


def close(layer: list) -> None:
    """Adds what inserts reach; their costs make three rounds enough."""
    for _ in range(3):
        for q in STATES:
            if layer[q] is not None and (layer[NEXT[q]] is None or layer[q][0] + INSERT <= layer[NEXT[q]][0]):
                new = layer[q][0] + INSERT, Prefix(layer[q][1], "I")
                if better(new, layer[NEXT[q]]):
                    layer[NEXT[q]] = new


def solve(rows: list[tuple[str, int, int]], start: int) -> list:
    """Per end state the cheapest (cost, prefix) over ``rows`` (initial, fault, copies), or None."""
    layer: list = [None] * 4
    layer[start] = (0, Prefix(None, ""))
    close(layer)
    for initial, fault, copies in rows:
        after: list = [None] * 4
        must = fault in (BLANK, DUPLICATE)
        # further copies of the row are blank or duplicates
        rest, spent = "D" * (copies - 1), DELETE * (copies - 1) + UNFINISHED * (fault == TRUNCATED)
        for q in STATES:
            if layer[q] is None:
                continue
            cost, before = layer[q]
            moves = [(q, "D", DELETE * copies)]
            if not must:
                moves.append((NEXT[q], "R", REROLE + spent))
                if initial in KEEPS[q]:
                    moves.append((KEEPS[q][initial], "K", KEEP + spent))
            for to, edit, price in moves:
                if after[to] is None or cost + price <= after[to][0]:
                    new = cost + price, Prefix(before, edit + rest)
                    if better(new, after[to]):
                        after[to] = new
        layer = after
        close(layer)
    return layer


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            yield from batch.slice(a, 1024).to_pylist()


def _groups(rows: Iterator[dict], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys, without holding a run."""
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


PIECE = ("segment long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
         "low long, high long, turns long, first_turn long, last_turn long, "
         "paths array<struct<start: int, stop: int, cost: long, audit: string>>")


def _pieces(id_field: pa.Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, last_segment = [], 0, None
        for (segment, _), group in _groups(_records(batches), ("segment", "conv_id")):
            rows = list(group)  # at most 2^SEGMENT_BITS
            p = {"conv_id": rows[0]["conv_id"], "segment": segment, "blank": 0, "duplicate": 0, "truncated": 0,
                 "illegal": 0, "first": rows[0]["initial"], "last": rows[-1]["initial"]}
            before = None
            for r in rows:
                copies, fault = r["copies"], r["fault"]
                p["blank"] += copies if fault == BLANK else 0
                p["duplicate"] += (copies - 1 if fault != BLANK else 0) + (fault == DUPLICATE)
                p["truncated"] += fault == TRUNCATED
                p["illegal"] += copies - 1 + (before is not None and before + r["initial"] not in ("su", "ua", "au"))
                before = r["initial"]
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            p |= {"turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
                  "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None}
            # only the first piece of a segment can go on from the one before
            starts = STATES if segment != last_segment else (0,)
            last_segment = segment
            steps = [(r["initial"], r["fault"], r["copies"]) for r in rows]
            p["paths"] = [{"start": s, "stop": q, "cost": end[0], "audit": end[1].since(0)}
                          for s in starts for q, end in enumerate(solve(steps, s)) if end is not None]
            out.append(p)
            held += sum(len(x["audit"]) for x in p["paths"]) + 200
            if held > 1 << 20:
                yield from _table(out, PIECE_FIELDS, id_field)
                out, held = [], 0
        yield from _table(out, PIECE_FIELDS, id_field)
    return run


PIECE_FIELDS = [*[(n, pa.int64()) for n in ("segment", "blank", "duplicate", "truncated", "illegal")],
                *[(n, pa.string()) for n in ("first", "last")],
                *[(n, pa.int64()) for n in ("low", "high", "turns", "first_turn", "last_turn")],
                ("paths", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()),
                                              ("audit", pa.string())])))]


def _table(rows: list[dict], fields: list, id_field: pa.Field) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([id_field, *fields]))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
CHOSEN = "segment long, start int, part string, audit string, " + ", ".join(f"{c} long" for c in COUNTS)
CHOSEN_FIELDS = [("segment", pa.int64()), ("start", pa.int32()), ("part", pa.string()), ("audit", pa.string()),
                 *[(c, pa.int64()) for c in COUNTS]]


def _choose(id_field: pa.Field):
    """Joins the pieces of each conversation; the totals are in the row of its last piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for (conv,), group in _groups(_records(batches), ("conv_id",)):
            layer: list = [(0, Prefix(None, "")), None, None, None]
            total = dict.fromkeys(COUNTS, 0)
            low = high = last = last_turn = None
            turns = 0
            for p in group:
                after: list = [None] * 4
                for path in p["paths"]:
                    if layer[path["start"]] is None:
                        continue
                    cost, before = layer[path["start"]]
                    new = cost + path["cost"], Prefix(before, path["audit"])
                    new[1].mark = p["segment"], path["start"]
                    if better(new, after[path["stop"]]):
                        after[path["stop"]] = new
                layer = after
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    total[c] += p[c]
                total["illegal"] += last is not None and last + p["first"] not in ("su", "ua", "au")
                last = p["last"]
                if p["turns"]:
                    turns += p["turns"] - (last_turn == p["first_turn"])
                    last_turn, high = p["last_turn"], p["high"]
                    low = p["low"] if low is None else low
            end = None
            for q in ENDS:
                if layer[q] is not None and better(layer[q], end):
                    end = layer[q]
            total["gaps"] = high - low + 1 - turns if turns else 0
            total["cost"] = end[0]
            chain = end[1].nodes()[1:]
            for node in chain:
                segment, start = node.mark
                done = node is chain[-1]
                out.append({"conv_id": conv, "segment": segment, "start": start, "part": node.text}
                           | ({"audit": end[1].since(0)} | total if done else {}))
                held += len(node.text) + (end[1].length if done else 0) + 100
                if held > 1 << 20:
                    yield from _table(out, CHOSEN_FIELDS, id_field)
                    out, held = [], 0
        yield from _table(out, CHOSEN_FIELDS, id_field)
    return run


class Writer:
    """The digest of a repaired conversation, row by row."""

    def __init__(self):
        self.sha, self.lines, self.part, self.at, self.state = hashlib.sha256(), 0, "", 0, 0

    def enter(self, part: str, start: int) -> None:
        self.part, self.at, self.state = part, 0, start

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def inserts(self) -> None:
        while self.at < len(self.part) and self.part[self.at] == "I":
            self.state = NEXT[self.state]
            self._line(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        self.inserts()
        edit = self.part[self.at]
        if edit == "K":
            self.state = KEEPS[self.state][role[0]]
            self._line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._line(ROLES[self.state], text)
        self.at += copies


RESULT = [*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _write(id_field: pa.Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for (conv,), group in _groups(_records(batches), ("conv_id",)):
            writer, total = Writer(), {}
            for r in group:
                if r["part"] is None:
                    writer.row(r["role"], r["text"], r["copies"])
                    continue
                writer.inserts()  # what ends the piece before
                writer.enter(r["part"], r["start"])
                if r["audit"] is not None:
                    total = {c: r[c] for c in (*COUNTS, "audit")}
            writer.inserts()
            out.append({"conv_id": conv, "repaired_sha256": writer.sha.hexdigest()} | total)
            held += len(total["audit"]) + 200
            if held > 1 << 20:
                yield from _table(out, RESULT, id_field)
                out, held = [], 0
        yield from _table(out, RESULT, id_field)
    return run


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after the damage that a hash of id and turn decides."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    h = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    return conversations.where(h != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(h == 3, 2).otherwise(1).cast("long").alias("copies"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, initial, fault, segment, place: all rows in order, staged."""
    equal = staged(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
                   .withColumn("digest", F.unhex(F.md5("text"))), "turns")
    first = (equal.groupBy(F.col("conv_id").alias("f_id"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"))
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"),
                  F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = (F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("role") == F.col("f_role"))
            & (F.col("digest") == F.col("f_digest")))
    bare = F.rtrim("text", F.lit(WHITE))
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    flagged = equal.join(first, same, "left").select(
        "conv_id", "turn", "role", "text", "copies", "digest", F.substring("role", 1, 1).alias("initial"),
        F.when(bare == "", BLANK).when(again, DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("fault"))
    order = ["conv_id", "turn", "role", "digest"]
    placed = (staged(flagged, "turn-faults").repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
              .withColumn("place", F.monotonically_increasing_id()))
    return staged(placed, "turns-in-order").withColumn("segment", F.shiftright("place", SEGMENT_BITS))


def repair(rows: DataFrame) -> DataFrame:
    """``rows``: conv_id, turn, role, text, copies.  One row per conversation: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    in_order = ordered_rows(rows)
    id_type = in_order.schema["conv_id"].dataType
    id_field = pa.field("conv_id", to_arrow_type(id_type))
    kind = id_type.simpleString()
    pieces = staged(in_order.select("segment", "place", "conv_id", "turn", "initial", "fault", "copies")
                    .repartition("segment").sortWithinPartitions("segment", "place")
                    .mapInArrow(_pieces(id_field), f"conv_id {kind}, {PIECE}"), "conversation-pieces")
    chosen = staged(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
                    .mapInArrow(_choose(id_field), f"conv_id {kind}, {CHOSEN}"), "conversation-audits")
    texts = in_order.select("conv_id", "segment", "place", "role", "text", "copies")
    stream = (texts.unionByName(chosen, allowMissingColumns=True)
              .repartition("conv_id").sortWithinPartitions("conv_id", "segment", F.col("place").asc_nulls_first()))
    result = ", ".join(f"{c} long" for c in COUNTS)
    return stream.mapInArrow(_write(id_field), f"conv_id {kind}, {result}, audit string, repaired_sha256 string")


def repair_all(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``repair`` with a row for each of ``ids`` (conv_id), also those without rows."""
    known = ids.select("conv_id").distinct()
    done = repair(rows).withColumnRenamed("conv_id", "r_id")
    return (known.join(done, F.col("conv_id").eqNullSafe(F.col("r_id")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
