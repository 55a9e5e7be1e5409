"""Token ids in length-delimited binary record files, with an offset index.

Documents are range-partitioned by id, encoded in Arrow batches, and every
task writes its range as files ``part-<partition>-<roll>.rec`` below one
folder of a shared store, so the file order is the id order.  A record:

    u64  payload length                  (all integers little-endian)
    u32  masked checksum of those 8 bytes
    payload: u8 1 if the document has an id, u8 bytes per token id (2 where the
             vocabulary allows, else 4), i64 id (0 without one), token ids
    u32  masked checksum of the payload

The checksum is CRC-32, masked by rotating it 15 bits right and adding
0xa282ead8, so that a checksum of data that holds checksums stays sound.  The
file ``.idx`` beside each ``.rec`` holds the u64 offset of every record and,
last, the file's length: a shuffled reader fetches record k by two numbers.

Files are written under a name of the task attempt and renamed when complete;
a retried or speculative task leaves the same bytes under the same name.

Defined cases: a null text is the empty text (only the end id); null ids come
last; documents repeated in id are ordered by a hash of their texts; an empty
table writes no file; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import staged, text_or_empty
from .pieces import (Known, Pieces, byte_level, byte_slices, gather, plain_letters, safe_parts,
                     utf8_lengths)

END_ID = 1
FILE_BYTES = 64 << 20
PART_CHARS = 1 << 16
MASK = 0xA282EAD8
SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
HEAD = struct.Struct("<BBq")
MANIFEST = "part int, roll int, path string, n_records long, n_tokens long, n_bytes long"


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def serialised(doc_id: int | None, width: int, packed: bytes) -> bytes:
    return HEAD.pack(doc_id is not None, width, doc_id or 0) + packed


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at ``at``, and where the next one starts."""
    head = data[at:at + 8]
    n = struct.unpack("<Q", head)[0]
    body = data[at + 12:at + 12 + n]
    if (struct.unpack_from("<I", data, at + 8)[0] != masked_crc(head)
            or struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(body)):
        raise ValueError(f"damaged record at byte {at}")
    return body, at + 16 + n


class WordBpe:
    """Ids of a lower-casing word BPE that drops white space; pieces are cut at ASCII white space.

    A stop or comma between an ASCII letter and white space is a piece of its
    own: the pre-tokenizer cuts there too.  Texts with a special string are
    encoded whole, since lower-casing first could make one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.known = Known(self._packed, 200)

    def _packed(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        plain = [plain_letters(p) and unicodedata.is_normalized("NFC", p) and p == p.lower() for p in pieces]
        for tokenizer, rows, prepare in (
                (self.model, [i for i, p in enumerate(plain) if p], byte_level),
                (self.whole, [i for i, p in enumerate(plain) if not p], str)):
            done = tokenizer.encode_batch_fast([prepare(pieces[i]) for i in rows], add_special_tokens=False)
            for i, e in zip(rows, done):
                out[i] = np.array(e.ids, f"<u{self.width}").tobytes()
        return out

    def _direct(self, text: str) -> bytes:
        parts = safe_parts(text, PART_CHARS, SAFE)
        done = self.whole.encode_batch_fast(parts, add_special_tokens=False)
        return b"".join(np.array(e.ids, f"<u{self.width}").tobytes() for e in done)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, packed in ``width`` bytes each."""
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])( |\n|$)", r"\1 \2\3")
        if odd.any():
            cut = pc.if_else(pa.array(odd), "", cut)
        pieces = Pieces(pc.ascii_split_whitespace(cut))
        flat, ends = gather(pieces, self.known(pieces.words), self.width)
        data, ends = flat.tobytes(), (ends * self.width).tolist()
        out = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for i in np.flatnonzero(odd):
            out[i] = self._direct(texts[i].as_py())
        return out


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _ENCODERS:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # Spark already runs a task per core
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def open_store(uri: str):
    """The store of a folder's URI and the folder's path in it."""
    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class _RecordFile:
    def __init__(self, store, root: str, name: str):
        self.store, self.name = store, f"{root}/{name}"
        self.tmp = f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out = store.open_output_stream(self.tmp + ".rec")
        self.offsets, self.size, self.n_tokens = [0], 0, 0

    def add(self, payload: bytes, n_tokens: int) -> None:
        data = frame(payload)
        self.out.write(data)
        self.size += len(data)
        self.n_tokens += n_tokens
        self.offsets.append(self.size)

    def close(self) -> tuple:
        self.out.close()
        with self.store.open_output_stream(self.tmp + ".idx") as out:
            out.write(np.array(self.offsets, "<u8").tobytes())
        for end in (".idx", ".rec"):
            self.store.move(self.tmp + end, self.name + end)
        return len(self.offsets) - 1, self.n_tokens, self.size


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID,
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the record files of ``docs`` to ``folder``; returns their manifest, one row a file."""
    keys = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie")]
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                           F.xxhash64(text_or_empty()).alias("tie"))
               .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, file, done = TaskContext.get().partitionId(), 0, None, []
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        width = encoder(tokenizer).width
        end = end_id.to_bytes(width, "little")

        def finish() -> None:
            done.append((part, roll, f"{folder}/part-{part:06d}-{roll:05d}", *file.close()))

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in byte_slices(utf8_lengths(texts)):
                for doc_id, packed in zip(ids[a:b], encoder(tokenizer).encode(texts.slice(a, b - a))):
                    if file is None:
                        file = _RecordFile(store, root, f"part-{part:06d}-{roll:05d}")
                    payload = serialised(doc_id, width, packed + end)
                    file.add(payload, len(packed) // width + 1)
                    if file.size >= file_bytes:
                        finish()
                        file, roll = None, roll + 1
        if file is not None:
            finish()
        if done:
            names = [f.split()[0] for f in MANIFEST.split(", ")]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    return staged(ordered.mapInArrow(run, MANIFEST), "record-manifest")


def read_file(path: str) -> memoryview:
    store, root = open_store(path)
    with store.open_input_file(root) as f:
        return memoryview(f.read())


def read_record(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record ``k`` of the file ``path`` (without its ending): two reads, by the index."""
    store, root = open_store(path + ".idx")
    with store.open_input_file(root) as f:
        a, b = np.frombuffer(f.read_at(16, 8 * k), "<u8").tolist()
    store, root = open_store(path + ".rec")
    with store.open_input_file(root) as f:
        return parse(unframe(memoryview(f.read_at(b - a, a)), 0)[0])


def parse(body: memoryview) -> tuple[int | None, np.ndarray]:
    has_id, width, doc_id = HEAD.unpack_from(body)
    return doc_id if has_id else None, np.frombuffer(body[HEAD.size:], f"<u{width}").astype("<u4")


def read_records(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """One row per record: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    order = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    n_files = manifest.count()
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                data = read_file(path + ".rec")
                offsets = np.frombuffer(read_file(path + ".idx"), "<u8").tolist()
                rows = []
                for at, after in zip(offsets[:-1], offsets[1:]):
                    body, end = unframe(data, at)
                    if end != after:
                        raise ValueError(f"{path}: index and record disagree at byte {at}")
                    doc_id, ids = parse(body)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids))
                                + ((ids.astype(np.int32),) if keep_ids else ()))
                    start += len(ids)
                types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return (files.select("path", "first").repartition(max(1, n_files)).mapInArrow(run, schema))


def record_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "llm-records")
