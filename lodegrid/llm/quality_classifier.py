"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good in the training split; unlabelled text is a sample of the
split's documents, whose labels are not looked at; negatives are never given. The class prior is
estimated from the two samples, and the non-negative unbiased risk is minimised over dense measures of
whole texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm.common import crc32_of_id, free_name, table, with_text
from lodegrid.llm.learners import Positives, class_prior, sigmoid

#: Bounds of the samples that the driver fits on: rows with a trusted label, and rows of the training split taken
#: as unlabelled (of rows that repeat an id, twice as many at most). Every document is scored by its whole text.
POSITIVES, UNLABELLED = 4000, 8000
_LETTERS = re.compile(r"[^\W\d_]")
_KEEP = {name: bytes(b for b in range(256) if b not in set(chars)) for name, chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>{}[]=+@^~_\\", "stop": b".,;:?", "shout": b"!", "white": b" \t\n\r\x0b\x0c"}.items()}


def measures(text: str | None) -> list[float]:
    """Dense measures of a whole text: shares of kinds of characters, word lengths, repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    count = {k: len(data.translate(None, drop)) for k, drop in _KEEP.items()}
    words = data.split()
    n = len(words)
    some = max(1, n)
    lines = [line for line in data.split(b"\n") if line.strip()]
    distinct = len(set(words))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    same = sum(map(bytes.__eq__, words, words[1:]))
    common = Counter(words).most_common(1)[0][1] if n else 0
    ends = sum(1 for w in words if w[-1] in b"#*$%&|!")
    letters = max(1, size - count["white"] - count["digit"] - count["symbol"] - count["stop"] - count["shout"])
    return [
        np.log1p(n),
        count["symbol"] / size,
        count["shout"] / size,
        count["upper"] / max(1, count["upper"] + count["lower"]),
        count["digit"] / size,
        count["stop"] / size,
        count["white"] / size,
        letters / some / 10,
        distinct / some,
        len(set(windows)) / max(1, len(windows)),
        1 - len(set(lines)) / max(1, len(lines)),
        same / some,
        common / some,
        ends / some,
        np.log1p(n / max(1, len(lines))),
        sum(1 for w in words if len(w) == 1) / some,
        sum(1 for w in words if len(w) > 25) / some,
        float(n < 6),
    ]


NAMES = [f"m{i}" for i in range(len(measures("")))]


def with_measures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    return with_text(df, text_col, lambda texts: [pa.array([measures(t) for t in texts], pa.list_(pa.float64()))], f"{name} array<double>")


def _sample(ids: DataFrame, docs: DataFrame, most: int) -> np.ndarray:
    """The measures of at most ``most`` documents, the first by a hash of their id; the ids are broadcast, ``most`` of them."""
    some = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = with_measures(texts, "text", "measures").select("doc_id", "measures").orderBy("doc_id").limit(2 * most).collect()
    return np.array([r.measures for r in rows], float).reshape(-1, len(NAMES))


class Model:
    """Scores measures; a constant where there was nothing to learn from."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        self.prior, self.net = 0.5, None
        if len(positive) < 5 or len(unlabelled) < 5:
            return
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self._scaled(positive), self._scaled(unlabelled)
        self.prior = class_prior(p, u)
        self.net = Positives().fit(p, u, self.prior)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.net is None else sigmoid(self.net.margin(self._scaled(x)))


def fit(docs: DataFrame, labels: DataFrame, split: F.Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on documents where ``split`` (of doc_id) holds. Null labels and ids are left out; an id with
    two labels counts as trusted if either says so."""
    trusted = labels.where(split & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    rest = docs.where(split & F.col("doc_id").isNotNull())
    return Model(_sample(trusted, docs, positives), _sample(rest, docs, unlabelled))


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` and the probability that each whole text is good. Null texts count as empty; other columns
    pass through; ``out_col`` replaces a column of that name."""
    name = free_name(df, "_score")

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(model.score(np.array([measures(t) for t in texts]).reshape(-1, len(NAMES))), pa.float64())]

    return with_text(df, text_col, run, f"{name} double").drop(out_col).withColumnRenamed(name, out_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null id is not held out (its checksum is 0)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc32_of_id() % 3 == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    out = score(docs, model).drop("text").withColumn("held_out", held)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
