"""Toxicity by a weighted lexicon.

1. Folding.  A text is split at ASCII white space; each piece becomes lower
   case, compatibility forms and lookalike letters of other scripts become
   Latin ones, invisible and combining signs go, and in runs that hold a letter
   digits and signs that stand for letters are replaced (1, i and l are one).
2. Lexicon.  Entries are folded words (`` idiot ``) and beginnings of words
   (`` idio``).  Seed words have a given weight.  From a bounded sample of
   labelled rows every word and beginning gets the logarithm of how much more
   often it occurs in toxic documents; entries that pass a likelihood-ratio
   test are kept, at most ``terms`` of them; not beginnings that stand for one
   longer entry only (they would match other words too).
3. Matching.  One Aho-Corasick automaton runs over the distinct pieces of a
   batch; a word counts its heaviest entry.  A hit inside an exception phrase
   (given ones, and learned ones: a hit with a neighbour word, seen in clean
   documents and not more often in toxic ones) counts nothing.
4. Score.  The summed weight, and the same per hundred words, go through a
   logistic curve that is fitted on sample rows that taught no entry, with a
   pull towards fixed coefficients, so that few labels do no harm.

A text's score depends on the whole text and nothing else.

The sample (the documented bound): at most ``toxic`` and ``clean`` labelled rows
in the order of a hash of their ids; all else covers every row.

Defined cases: a null text is the empty text, whose score is that of a text
without hits; without labelled rows the seed words and the fixed coefficients
count; null labels teach nothing, labels repeated for an id count as the
smallest; null and repeated ids are kept as they are; an empty table gives an
empty result; other columns are carried through, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty
from .pieces import Known, Pieces, byte_slices, ragged_sum, utf8_lengths

TOXIC, CLEAN, TERMS = 4096, 8192, 4096
FLAG = 0.7
#: lengths of beginnings of words
BEGINNINGS = (3, 4, 5, 6)
#: likelihood-ratio statistic and weight that an entry needs
EVIDENCE, LEAST_WEIGHT, MOST_WEIGHT = 24.0, 1.5, 5.0
SEED_WEIGHT = 2.0
#: a beginning goes if one longer entry has this share of its toxic documents
EXPLAINED = 0.8

# Seed words, phrases without malice, letters that look alike, signs for letters.
SEED = ("asshole bastard bitch crap cretin cunt damn dickhead disgusting dumbass fuck fucking idiot imbecile "
        "jackass loser moron motherfucker pathetic retard scum shit slut stupid twat wanker whore worthless").split()
EXCEPTIONS = ("loser bracket", "loser tree", "pond scum", "scum of the", "bastard sword", "damn good", "holy shit")
LOOKALIKES = str.maketrans(
    "авекмнорстухгіјѕԁԛԝһαβεικνορτυχγηωҽɑɡɩ",
    "abekmhopctyxrijsdqwhabeikvoptuxynweagi")
SIGNS = str.maketrans("0134578@$l", "oieastbasi")

RUN = re.compile(r"(?:[^\W_]|[@$])+")
#: intercept, log of the weight, log of the weight per hundred words
PRIOR = np.array([-3.0, 1.0, 1.5])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fold(piece: str) -> list[str]:
    """The folded words of a piece of text without white space."""
    piece = piece.lower()
    if not piece.isascii():
        piece = unicodedata.normalize("NFKC", piece).lower().translate(LOOKALIKES)
        piece = "".join(c for c in piece if unicodedata.category(c) not in ("Cf", "Mn"))
    runs = RUN.findall(piece)
    return [r.translate(SIGNS) if any(map(str.isalpha, r)) else r for r in runs]


def folded(words: str) -> str:
    """A phrase as the automaton sees it: folded words between single spaces."""
    return " " + " ".join(w for piece in words.split() for w in fold(piece)) + " "


def entries_of(words: set[str]) -> set[str]:
    """All entries that a set of folded words could be matched by."""
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for entry, weight in weights.items():
        out.add_word(entry, (len(entry), weight))
    if len(out):
        out.make_automaton()
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: dict[str, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=PRIOR.copy)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("weights", "exceptions", "curve")}

    def _ready(self) -> None:
        if "entries" not in self.__dict__:
            self.entries, self.phrases = automaton(self.weights), automaton(self.exceptions)
            self.known = Known(self.match, 180)

    def match(self, pieces: list[str]) -> list[float]:
        """The weight of each piece: of each of its words the heaviest entry."""
        out = [0.0] * len(pieces)
        if not len(self.entries):
            return out
        parts, starts, at = [], [], 0
        for piece in pieces:
            parts.append(" " + " ".join(fold(piece)) + " \n")
            starts.append(at)
            at += len(parts[-1])
        best: dict[int, float] = {}
        for end, (n, weight) in self.entries.iter("".join(parts)):
            first = end - n + 1
            best[first] = max(weight, best.get(first, 0.0))
        owners = np.searchsorted(starts, list(best), side="right") - 1
        for owner, weight in zip(owners.tolist(), best.values()):
            out[owner] += weight
        return out

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, float, str, str, str]]:
        """Row, weight, and the pieces before, at and after each hit that no exception phrase covers."""
        self._ready()
        pieces = Pieces(pc.ascii_split_whitespace(texts))
        weight = np.array(self.known(pieces.words), np.float64)[pieces.codes] if len(pieces.codes) else np.zeros(0)
        words, codes = pieces.words, pieces.codes
        for i in np.flatnonzero(weight).tolist():
            row = int(np.searchsorted(pieces.offsets, i, side="right")) - 1
            before = words[codes[i - 1]] if i > pieces.offsets[row] else ""
            after = words[codes[i + 1]] if i + 1 < pieces.offsets[row + 1] else ""
            if len(self.phrases) and any(True for _ in self.phrases.iter(folded(f"{before} {words[codes[i]]} {after}"))):
                continue
            yield row, float(weight[i]), before, words[codes[i]], after

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: one, log of the weight, log of the weight per hundred words."""
        total = np.zeros(len(texts))
        for row, weight, *_ in self.hits(texts):
            total[row] += weight
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        real = pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
        n = np.maximum(ragged_sum(real, offsets - offsets[0]), 1)
        return np.stack([np.ones(len(texts)), np.log1p(total), np.log1p(100 * total / n)], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    for a, b in byte_slices(utf8_lengths(texts)):
        yield texts.slice(a, b - a)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """label, text, teaches (entries; the others fit the curve) of the labelled sample, staged."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("toxic").alias("label"))
             .join(docs.select("doc_id"), "doc_id", "left_semi")
             .select(F.col("doc_id").alias("l_id"), (F.col("label") == 1).alias("label"),
                     F.md5(F.col("doc_id").cast("string")).alias("draw")))
    chosen = staged(known.where("label").orderBy("draw", "l_id").limit(toxic)
                    .unionByName(known.where("not label").orderBy("draw", "l_id").limit(clean)), "toxic-ids")
    rows = (docs.select("doc_id", text_or_empty().alias("text"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
            .groupBy("l_id", "label", "draw").agg(F.min("text").alias("text")))
    return staged(rows.select("label", "text", (F.conv(F.substring("draw", -2, 2), 16, 10).cast("int") % 3 > 0)
                              .alias("teaches")), "toxic-sample")


def _counted(found: Iterator[tuple[str, bool]]) -> pa.RecordBatch:
    yes, no = Counter(), Counter()
    for entry, label in found:
        (yes if label else no)[entry] += 1
    names = list(yes | no)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([yes[x] for x in names], pa.int64()),
         pa.array([no[x] for x in names], pa.int64())], ["entry", "yes", "no"])


def _totals(sample: DataFrame, find) -> DataFrame:
    """entry, yes, no: sample documents with the entry, by label.  ``find``: texts -> row, entry (distinct)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("text"), batch.column("label").to_pylist()
            for a, b in byte_slices(utf8_lengths(texts)):
                yield _counted((entry, labels[a + row]) for row, entry in find(texts.slice(a, b - a)))

    return (sample.select("text", "label").mapInArrow(run, "entry string, yes long, no long")
            .groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))


def learn_entries(sample: DataFrame, terms: int = TERMS) -> dict[str, float]:
    """Weights of the entries that the sample gives evidence for, over the seed words."""
    def find(texts: pa.Array) -> Iterator[tuple[int, str]]:
        for row, text in enumerate(texts.to_pylist()):
            words = {w for piece in set(text.split()) for w in fold(piece)}
            yield from ((row, e) for e in entries_of(words))

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = size.get(True, 0), size.get(False, 0)
    weights = {folded(w): SEED_WEIGHT for w in SEED}
    if not yes or not no:
        return weights
    share = F.lit(yes / (yes + no))
    both = F.col("yes") + F.col("no")
    excess = lambda seen, part: F.when(seen > 0, seen * F.log(seen / (both * part))).otherwise(F.lit(0.0))
    counts = _totals(sample, find).select(
        "entry", "yes",
        (2 * (excess(F.col("yes"), share) + excess(F.col("no"), 1 - share))).alias("evidence"),
        (F.log((F.col("yes") + 1) / (yes + 2)) - F.log((F.col("no") + 1) / (no + 2))).alias("weight"))
    counts = staged(counts, "toxic-counts")
    for r in counts.where(F.col("entry").isin(list(weights))).collect():  # a seed word that clean texts hold weighs less
        weights[r["entry"]] = min(SEED_WEIGHT, max(0.0, r["weight"])) if r["weight"] < LEAST_WEIGHT else SEED_WEIGHT
    best = (counts.where((F.col("evidence") >= EVIDENCE) & (F.col("weight") >= LEAST_WEIGHT))
            .orderBy(F.desc("evidence"), "entry").limit(terms).collect())
    seen = {r["entry"]: r["yes"] for r in best}
    told = {entry[:k] for entry, n in seen.items() for k in range(1, len(entry)) if n >= EXPLAINED * seen.get(entry[:k], n + 1)}
    weights |= {r["entry"]: min(r["weight"], MOST_WEIGHT) for r in best if r["entry"] not in told}
    return {e: w for e, w in weights.items() if w > 0}


def learn_exceptions(sample: DataFrame, lexicon: Lexicon, terms: int = TERMS) -> dict[str, float]:
    """Pairs of a hit and its neighbour that clean documents hold at least as often as toxic ones."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def find(texts: pa.Array) -> Iterator[tuple[int, str]]:
        pairs = {(row, folded(pair)) for row, _, before, hit, after in shared.value.hits(texts)
                 for pair in (f"{before} {hit}" if before else "", f"{hit} {after}" if after else "") if pair}
        yield from ((row, pair) for row, pair in pairs if pair.count(" ") >= 3)

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = [F.col(c) / max(size.get(v, 0), 1) for c, v in (("no", False), ("yes", True))]
    rows = (_totals(sample, find).where((F.col("no") >= 2) & (rate[0] >= rate[1]))
            .orderBy(F.desc("no"), "entry").limit(terms).collect())
    return {r["entry"]: 1.0 for r in rows}


def fit_curve(features: np.ndarray, labels: np.ndarray, pull: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic coefficients, both classes of equal mass, pulled towards ``PRIOR`` (Newton steps)."""
    curve = PRIOR.copy()
    if not len(labels) or labels.all() or not labels.any():
        return curve
    mass = np.where(labels, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ curve, -30, 30)))
        slope = features.T @ (mass * (p - labels)) + pull * (curve - PRIOR)
        bend = (features * (mass * p * (1 - p))[:, None]).T @ features + pull * np.eye(len(curve))
        step = np.linalg.solve(bend, slope)
        curve = curve - step
        if np.abs(step).max() < 1e-8:
            break
    return curve


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, terms: int = TERMS) -> Lexicon:
    sample = labelled_sample(docs, labels, toxic, clean)
    teach = sample.where("teaches")
    lexicon = Lexicon(learn_entries(teach, terms), {folded(p): 1.0 for p in EXCEPTIONS})
    lexicon.exceptions |= learn_exceptions(teach, lexicon, terms)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in byte_slices(utf8_lengths(texts)):
                x = shared.value.features(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(x[:, 1]), pa.array(x[:, 2])],
                                                 ["label", "weight", "density"])

    rows = (sample.where("not teaches").select("text", "label").mapInArrow(run, "label boolean, weight double, density double")
            .orderBy("label", "weight", "density").collect())
    x = np.array([[1.0, r["weight"], r["density"]] for r in rows]).reshape(len(rows), 3)
    lexicon.curve = fit_curve(x, np.array([r["label"] for r in rows], bool))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Columns ``doc`` (struct of the input row) and score.  Only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.scores(t) for t in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.withColumn("score", scored(text_or_empty("doc.text")))
