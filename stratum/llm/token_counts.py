"""Token counts: byte-level BPE lengths of whole texts.

Arrow functions receive texts in slices balanced by bytes and return lengths
only.  Texts are cut at safe boundaries (before a space or around a line
break that stands alone between other characters), distinct pieces are
encoded once per worker, and a text's count is the sum over its pieces.  Texts
with two blanks in one run of white space, or with the separator character,
go to the library as they are; long ones in parts cut between a letter and a
single space before a letter.

Counts equal those of the library on the whole text, with no special tokens
added and the special strings inside a text handled as is its default.

Defined cases: a null text is the empty text with 0 tokens; null and repeated
ids are kept as they are; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import (SEP, Known, Pieces, byte_level, byte_slices, plain_letters, ragged_sum,
                     safe_parts, utf8_lengths)

_BLANK = r"[\t-\r\x{85}\p{Z}]"
#: Texts in which cutting before every space and around every line break may be unsafe.
IRREGULAR = rf"{SEP}| {_BLANK}* |\n{_BLANK}|{_BLANK}\n"
PART_CHARS = 1 << 16
SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class ByteBpeCounter:
    """Counts of one byte-level BPE file; one instance per worker process and file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)  # no normaliser, no pre-tokenizer
        self.known = Known(self._lengths, 150)

    def _lengths(self, pieces: list[str]) -> list[int]:
        out = np.empty(len(pieces), np.int64)
        plain = np.fromiter((plain_letters(p[1:] if p[:1] == " " else p) for p in pieces), bool, len(pieces))
        for tokenizer, rows, prepare in ((self.model, np.flatnonzero(plain), byte_level),
                                         (self.whole, np.flatnonzero(~plain), str)):
            done = tokenizer.encode_batch_fast([prepare(pieces[i]) for i in rows], add_special_tokens=False)
            out[rows] = [len(e) for e in done]
        return out.tolist()

    def _direct(self, text: str) -> int:
        parts = safe_parts(text, PART_CHARS, SAFE)
        return sum(len(e) for e in self.whole.encode_batch_fast(parts, add_special_tokens=False))

    def counts(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", SEP + " "), "\n", f"{SEP}\n{SEP}")
        if odd.any():
            marked = pc.if_else(pa.array(odd), "", marked)
        pieces = Pieces(pc.split_pattern(marked, SEP))
        lengths = np.array(self.known(pieces.words), np.int64)
        out = ragged_sum(lengths[pieces.codes] if len(pieces.codes) else lengths, pieces.offsets)
        for i in np.flatnonzero(odd):
            out[i] = self._direct(texts[i].as_py())
        return out


_COUNTERS: dict[str, ByteBpeCounter] = {}


def counter(path: str) -> ByteBpeCounter:
    if path not in _COUNTERS:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # Spark already runs a task per core
        _COUNTERS[path] = ByteBpeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer``: path of a byte-level BPE file of the tokenizers library, present on every node.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).counts
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_bytes = utf8_lengths(texts)
            for a, b in byte_slices(n_bytes):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n_bytes[a:b]),
                     pa.array(count(texts.slice(a, b - a)))], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
