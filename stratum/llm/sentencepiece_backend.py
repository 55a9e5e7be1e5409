"""SentencePiece models run by the tokenizers library.

``read_model`` parses the model's protobuf, ``build_tokenizer`` rebuilds the
normaliser (precompiled character map, white-space rules), the metaspace
marker and its dummy prefix, the model (unigram scores, or merges ordered by
score for a BPE model) and byte fallback.  ``parity`` holds the result against
the sentencepiece library.

Where no vocabulary piece has the marker after another character, no token
crosses the place before a run of markers.  Then texts are cut there, distinct
pieces are encoded (and decoded) once per worker in multithreaded batches, and
the ids and decoded texts of whole documents are gathered from them.  Texts
with two spaces in a row, the separator or the marker itself are encoded
whole.  Models with a character map or with pieces across the marker take the
whole-text path for every text.

Defined cases: a null text is the empty text, which has no ids and decodes to
itself; null and repeated ids are kept as they are; an empty table gives an
empty result; other columns are carried through, except that the new columns
replace those of the same name.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes
from .pieces import SEP, Known, Pieces, byte_slices, gather, give_back, utf8_lengths

MARK = "▁"
# fixed values of the model format: field numbers, piece types, model types
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
#: Bytes of text that are cut into pieces at once (what this makes of them takes over 20 times as much).
PART_BYTES = 1 << 19
#: Bytes of pieces that a worker keeps with their ids.
KEEP_BYTES = 40 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protobuf message: number and raw value."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    mark_spaces: bool = True


def read_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == PIECES:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == TRAINER:
            spec = dict(fields(value))
            model.kind = spec.get(3, UNIGRAM)
            model.byte_fallback = bool(spec.get(35, 0))
        elif number == NORMALIZER:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix = bool(spec.get(3, 1))
            model.squeeze_spaces = bool(spec.get(4, 1))
            model.mark_spaces = bool(spec.get(5, 1))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All pairs that join to a piece, by descending score of the piece; pairs of
    one score by the lengths of their sides, the longer left side first, as the
    leftmost pair is joined first."""
    rank = {p: (-score, i) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    pairs = []
    for piece, (key, i) in rank.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in rank and right in rank:
                pairs.append((key, -len(left), len(right), i, left, right))
    return [(left, right) for *_, left, right in sorted(pairs)]


def cuts_at_marks(model: Model) -> bool:
    return model.mark_spaces and not any(
        MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def build_core(model: Model):
    """The vocabulary and its scores or merges; tokenizers can share one."""
    from tokenizers import models
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        return models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown,
                              byte_fallback=model.byte_fallback)
    return models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model),
                      unk_token=model.pieces[unknown][0], fuse_unk=True,
                      byte_fallback=model.byte_fallback)


def build_tokenizer(model: Model, dummy_prefix: bool | None = None, core=None):
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, normalizers, pre_tokenizers
    prefix = model.dummy_prefix if dummy_prefix is None else dummy_prefix
    tokenizer = Tokenizer(core or build_core(model))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.mark_spaces:
        steps += [normalizers.Replace(" ", MARK)]
    if prefix:
        steps += [normalizers.Prepend(MARK if model.mark_spaces else " ")]
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if cuts_at_marks(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        + [decoders.Strip(" ", 1, 0)] * prefix)
    return tokenizer


class Codec:
    """Encoder and decoder of one model file; one instance per worker process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = read_model(f.read())
        core = build_core(model)
        self.whole = build_tokenizer(model, core=core)
        self.piecewise = (cuts_at_marks(model) and model.dummy_prefix and not model.charsmap
                          and not model.squeeze_spaces
                          and not any(kind == USER for *_, kind in model.pieces))
        self.part = build_tokenizer(model, dummy_prefix=False, core=core)
        self.known = Known(self._pieces, 330, KEEP_BYTES)
        # a line break in no piece of several characters is a piece of its own
        self.alone = not any("\n" in p and len(p) > 1 for p, _, kind in model.pieces
                             if kind in (NORMAL, USER))

    def _pieces(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        ids = [e.ids for e in self.part.encode_batch_fast(pieces, add_special_tokens=False)]
        # a piece that decodes to itself is kept once
        return [(np.array(i, "<u4").tobytes(), piece if text == piece else text)
                for piece, i, text in zip(pieces, ids, self.part.decode_batch(ids, skip_special_tokens=False))]

    def run(self, texts: pa.Array) -> tuple[list[bytes], list[str]]:
        """Packed ids and decoded text of each text."""
        odd = (pc.match_substring_regex(texts, f"^ |  |{SEP}|{MARK}").to_numpy(zero_copy_only=False)
               if self.piecewise else np.ones(len(texts), bool))
        odd |= utf8_lengths(texts) == 0
        # a piece starts before each space
        marked = pc.replace_substring(pc.binary_join_element_wise(" ", texts, ""), " ", SEP + " ")
        marked = pc.replace_substring(marked, "\n", f"{SEP}\n{SEP}") if self.alone else marked
        if odd.any():
            marked = pc.if_else(pa.array(odd), "", marked)
        lists = pc.split_pattern(marked, SEP)
        pieces = Pieces(lists)
        known = self.known(pieces.words)
        flat, ends = gather(pieces, [packed for packed, _ in known])
        data, ends = flat.tobytes(), (ends * 4).tolist()
        ids = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        words = pa.array([text for _, text in known], pa.string()).take(pa.array(pieces.codes))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(pieces.offsets, pa.int32()), words), "")
        decoded = [t[1:] for t in joined.to_pylist()]  # without the space of the prefix
        rows = np.flatnonzero(odd)
        done = self.whole.encode_batch_fast([texts[i].as_py() for i in rows], add_special_tokens=False)
        back = self.whole.decode_batch([e.ids for e in done], skip_special_tokens=False)
        for i, e, text in zip(rows, done, back):
            ids[i], decoded[i] = np.array(e.ids, "<u4").tobytes(), text
        return ids, decoded


_CODECS: dict[str, Codec] = {}


def drop_codecs() -> bool:
    """The tokenizers of this process go; a later task builds its own again."""
    some = bool(_CODECS)
    for work in _CODECS.values():
        Known.tables[:] = [t for t in Known.tables if t is not work.known]
    _CODECS.clear()
    return some


Known.holders.append(drop_codecs)


def codec(path: str, threads: int = THREADS) -> Codec:
    if path not in _CODECS:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str, threads: int = THREADS, keep_decoded: bool = True) -> DataFrame:
    """``docs`` with n_tokens, input_ids, ids_crc32, decoded and round_trip.

    ``model``: path of a SentencePiece model file, present on every node.  Without
    ``keep_decoded`` the decoded text is compared but not returned.
    """
    batches_by_bytes(docs.sparkSession, 1 << 20)
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    types = ("doc " + schema.schema["doc"].dataType.simpleString()
             + ", n_tokens long, input_ids array<int>, ids_crc32 long, "
             + "decoded string, " * keep_decoded + "round_trip boolean")
    new = ["n_tokens", "input_ids", "ids_crc32", *["decoded"] * keep_decoded, "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what other stages left goes before the tables are built
        Known.release(but=_CODECS[model].known if model in _CODECS else None)
        give_back()
        work = codec(model, threads)
        give_back()
        for batch in batches:
            texts = pc.fill_null(batch.column("doc").field("text"), "")
            for a, b in byte_slices(utf8_lengths(texts), PART_BYTES):
                part = texts.slice(a, b - a)
                ids, decoded = work.run(part)
                lengths = [len(i) // 4 for i in ids]
                values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                decoded = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, b - a), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64()), *[decoded] * keep_decoded,
                     pc.equal(decoded, part)], ["doc", *new])
        give_back()  # idle workers keep the tables, not what the task has freed

    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in new]
    return schema.mapInArrow(run, types).select(*kept, *new)


def parity(texts: list[str], path: str) -> list[int]:
    """Rows of ``texts`` whose ids differ from the sentencepiece library's."""
    import sentencepiece
    theirs = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    ours, _ = codec(path).run(pa.array(texts, pa.string()))
    return [i for i, (a, b) in enumerate(zip(ours, theirs)) if np.frombuffer(a, "<u4").tolist() != b]
