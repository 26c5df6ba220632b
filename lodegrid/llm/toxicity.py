"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the training split: words, and word beginnings of four letters and more
(so that stems count in languages that inflect), which stand in many more toxic documents than in
others. Features are the lexicon's densities, how near hits stand to second-person words, capitals,
punctuation, and obfuscation (hits that show only when look-alike characters are read as letters). A
training document's own words are taken out of the counts before its features are made, so that the
trees see it as they will see a new document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm.common import crc32_of_id, cut, fields, free_name, table, tidied, with_text
from lodegrid.llm.learners import BoostedTrees, Isotonic, calibrated_trees

#: Bound of the labelled sample that is fitted, and of the lexicon (the heaviest entries stay).
LABELLED, LEXICON = 10_000, 20_000
#: Pieces of text whose weight a worker remembers.
WORDS = 150_000
#: Least weight (a log ratio of document shares) of a lexicon entry, and of a strong one.
WEAK, STRONG = math.log(3), math.log(20)
#: Second-person words of the languages at hand, and characters that stand in for letters.
SECOND = set("you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"\w[0-9@$!*._-]+\w|[@$]\w")
WINDOW = 20


def entries(word: str) -> list[str]:
    """The lexicon entries that a word can match: itself, and its beginnings of 4 to 8 letters (marked)."""
    return [word, *(f"{word[:n]}*" for n in range(4, min(8, len(word)) + 1))]


class Lexicon:
    """Entry -> (toxic documents, other documents) and how many documents of each kind there were."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, other: int):
        self.counts, self.toxic, self.other = counts, toxic, other
        self.least = max(3, math.ceil(0.01 * toxic))
        self.words: dict[tuple[str, int], float] = {}

    def weight(self, entry: str, own: int) -> float:
        """The entry's weight; ``own``: 1 or 0, the label of a training document to leave out, or -1."""
        a, b = self.counts.get(entry, (0, 0))
        toxic, other = self.toxic - (own == 1), self.other - (own == 0)
        a, b = a - (own == 1), b - (own == 0)
        if a < self.least:
            return 0.0
        return math.log((a + 0.5) / (toxic + 1)) - math.log((max(b, 0) + 0.5) / (other + 1))

    def chunk(self, chunk: str, own: int) -> float:
        """The heaviest weight in a piece of text between white space; negative if it shows only once
        look-alike characters are read as letters."""
        key = (chunk, own)
        if key not in self.words:
            if len(self.words) > WORDS:
                self.words.clear()
            plain = max((self.weight(e, own) for w in _WORD.findall(chunk) for e in entries(w)), default=0.0)
            out = plain
            if plain < WEAK and _ODD.search(chunk):
                read = chunk.strip(".,;:!?\"'()[]*_-").translate(LOOKALIKE)
                hidden = max((self.weight(e, own) for w in _WORD.findall(read) for e in entries(w)), default=0.0)
                out = -hidden if hidden >= WEAK else plain
            self.words[key] = out if abs(out) >= WEAK else 0.0
        return self.words[key]


def features(text: str | None, lexicon: Lexicon, own: int = -1) -> list[float]:
    text = text or ""
    chunks = text.lower().split()
    n = max(1, len(chunks))
    weight = np.array([lexicon.chunk(c, own) for c in chunks]) if chunks else np.zeros(0)
    at = np.flatnonzero(weight)
    heavy = np.abs(weight[at])
    strong = at[heavy >= STRONG]
    hidden = int((weight[at] < 0).sum())
    second = np.array([i for i, c in enumerate(chunks) if c.strip(".,;:!?\"'") in SECOND], np.int64)
    near = 0
    if len(second) and len(at):
        place = np.searchsorted(second, at)
        gap = np.minimum(np.abs(second[np.minimum(place, len(second) - 1)] - at), np.abs(at - second[np.maximum(place - 1, 0)]))
        near = int((gap <= 5).sum())
    crowd = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max()) if len(at) else 0
    kinds = len({chunks[i] for i in at})
    size = max(1, len(text))
    letters = max(1, len(_OTHER.sub("", text)))
    upper = len(_UPPER.findall(text))
    return [
        float(len(at)),
        float(len(strong)),
        100 * len(at) / n,
        100 * len(strong) / n,
        float(heavy.max()) if len(at) else 0.0,
        float(heavy.sum()),
        float(heavy.sum()) / n,
        float(kinds),
        float(crowd),
        float(near),
        100 * near / n,
        float(hidden),
        100 * hidden / n,
        float(np.sort(heavy)[-2]) if len(at) > 1 else 0.0,
        math.log1p(len(chunks)),
        upper / letters,
        text.count("!") / size,
        text.count("?") / size,
        sum(map(text.count, "*$#@%&")) / size,
        100 * len(second) / n,
        sum(map(text.count, ".,;:")) / size,
    ]


_UPPER, _OTHER = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile(r"[\W\d_]+")


class Model:
    """A lexicon, trees and a calibration; a constant where there was nothing to learn from."""

    def __init__(self, lexicon: Lexicon | None, trees: BoostedTrees | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), -1)
        return self.calibration.apply(self.trees.margin(x)) if len(texts) else np.zeros(0)


def _counts(training: DataFrame, toxic: int, wanted: dict[str, int] | None) -> DataFrame:
    """(entry, n): documents of one label that hold an entry (of ``wanted``, if given), counted in each task first."""
    schema = fields("entry string", "n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=schema.names)
            found.clear()
            return batch

        for whole in batches:
            for batch in cut(whole, 0):
                for text in batch.column(0).to_pylist():
                    seen = {e for w in set(_WORD.findall((text or "").lower())) for e in entries(w)}
                    found.update(seen if wanted is None else seen & wanted.keys())
                    if len(found) > 300_000:
                        yield out()
        yield out()

    return training.where(F.col("toxic") == toxic).select("text").mapInArrow(tidied(run), schema).groupBy("entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, split: F.Column, labelled: int = LABELLED, size: int = LEXICON) -> Model:
    """Fit on at most ``labelled`` labelled documents where ``split`` (of doc_id) holds, the first by a
    hash of their id (of documents that repeat an id, ``2 * labelled`` rows at most), with a lexicon of the
    ``size`` heaviest of the ``5 * size`` entries that stand in most of the sample's toxic documents: bounds of
    the fit only, every document is scored by its whole text. Null ids and labels are left out; an id with two labels counts as toxic if either
    says so. Without toxic or without other documents every score is their share. Ids keep the types that the tables give them."""
    known = labels.where(split & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = [tuple(r) for r in some.collect()]  # ``labelled`` pairs of an id and a number at most
    picked = docs.sparkSession.createDataFrame(rows, some.schema)
    training = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    toxic = sum(t == 1 for _, t in rows)
    other = len(rows) - toxic
    if not toxic or not other:
        return Model(None, None, None, toxic / len(rows) if rows else 0.0)
    least = max(3, math.ceil(0.01 * toxic))
    top = _counts(training, 1, None).where(F.col("n") >= least).orderBy(F.desc("n"), "entry").limit(5 * size).collect()
    wanted = {r.entry: r.n for r in top}
    rest = {r.entry: r.n for r in _counts(training, 0, wanted).collect()}
    lexicon = Lexicon({e: (n, rest.get(e, 0)) for e, n in wanted.items()}, toxic, other)
    kept = sorted(lexicon.counts, key=lambda e: (-lexicon.weight(e, -1), e))[:size]
    lexicon.counts = {e: lexicon.counts[e] for e in kept if lexicon.weight(e, -1) >= WEAK - 0.3}
    training = training.select("doc_id", "text", "toxic")
    order = [F.length("doc_id")] if isinstance(training.schema["doc_id"].dataType, T.StringType) else []  # numerals as their numbers
    schema = T.StructType([training.schema["doc_id"], *fields("toxic int", "x array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, 1):
                x = [features(t, lexicon, y) for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    made = training.mapInArrow(tidied(run), schema).orderBy(*order, "doc_id", "x").limit(2 * labelled).collect()
    x, y = np.array([r.x for r in made]), np.array([float(r.toxic) for r in made])
    lexicon.words.clear()
    return Model(lexicon, *calibrated_trees(x, y), toxic / len(rows)) if len(made) else Model(None, None, None, toxic / len(rows))


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` and the probability that each whole text is toxic. Null texts count as empty; other columns
    pass through; ``out_col`` replaces a column of that name."""
    name = free_name(df, "_score")
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon's and the trees' sizes
    made = with_text(df, text_col, lambda texts: [pa.array(shipped.value.score(texts), pa.float64())], f"{name} double")
    return made.drop(out_col).withColumnRenamed(name, out_col)


def train(spark: SparkSession, sf_dir: str) -> Model:
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc32_of_id() % 5 != 0)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under one half, with their columns as they are."""
    name = free_name(docs, "_toxic")
    return score(docs, model, text_col, name).where(F.col(name) < 0.5).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null id is held out (its checksum is 0)."""
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), train(spark, sf_dir)).drop("text")
    return out.select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
