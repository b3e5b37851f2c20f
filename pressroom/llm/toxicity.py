"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's chance of being toxic is a logistic function of its distinct words
and their beginnings;
a document is toxic unless none of its sentences is and the label's own error rate (a leak) doesn't strike:
p = 1 - (1 - leak) * prod(1 - s_i).  The noisy-or is trained from document labels alone, by full-batch gradient
steps on the likelihood, and the sentence chances then locate the offending sentences.

Training reads a bounded sample of labelled documents (``TRAIN_ROWS``; by a hash of the id) and runs on the driver
over the words that occur in at least ``MIN_DOCS`` of them and go with a label (``LEAST_Z``).  Scoring is one narrow Arrow stage over whole
texts; the model is at most ``MAX_WORDS`` words and travels in the closure.

Defined results: NULL and empty texts have no sentence and score the leak; documents labelled more than once or with
a NULL label are left out of training, as are ids that aren't in both tables; without both classes in training the
score is the share of toxic labels (0 if there are none); repeated rows give repeated results; other columns, labels,
language, source and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the training sample, in documents; of a training text, in no way: whole texts are read.
TRAIN_ROWS = 4000
MIN_DOCS = 5
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5, 6, 7, 8)
#: Standard deviations by which a word's share of toxic labels must differ from the base rate.
LEAST_Z = 5.0
MAX_WORDS = 50_000
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
_WORD = re.compile(r"\w+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences with a word in them."""
    text = text or ""
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if _WORD.search(text, a, b)]


def features(word: str) -> list[str]:
    """A word and its beginnings (marked), for words of one stem."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    leak: float
    words: dict[str, float] = field(default_factory=dict)  # sums of words met, bounded

    def word(self, w: str) -> float:
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        x = self.words[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return x

    def sentence(self, text: str) -> float:
        z, get = self.bias, self.words.get
        for w in set(_WORD.findall(text.lower())):
            x = get(w)
            z += self.word(w) if x is None else x
        return 1 / (1 + math.exp(-z)) if z > -50 else 0.0

    def score(self, text: str | None) -> float:
        """The noisy-or over the text's sentences, kept in [0, 1]."""
        rest = 1 - self.leak
        for a, b in sentences(text):
            rest *= 1 - self.sentence(text[a:b])
        return float(min(1.0, max(0.0, 1 - rest)))

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int]]:
        """The offending sentences: (start, end) in code points."""
        return [(a, b) for a, b in sentences(text) if self.sentence(text[a:b]) >= least]


def fit(texts: list[str | None], labels: list[int], steps: int = 150, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Train the noisy-or on whole texts by Adam steps on the mean log likelihood with an L2 penalty."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -60.0, float(y.mean()) if len(y) else 0.0)
    seen: dict[str, int] = {}
    toxic: dict[str, int] = {}
    for t, label in zip(texts, labels):
        for w in {f for w in set(_WORD.findall((t or "").lower())) for f in features(w)}:
            seen[w] = seen.get(w, 0) + 1
            if label:
                toxic[w] = toxic.get(w, 0) + 1
    # a word takes part if its documents' labels differ from the others' by more than wrong labels make by chance
    base = y.mean()
    apart = {w: abs(toxic.get(w, 0) - base * n) / (n * base * (1 - base)) ** 0.5
             for w, n in seen.items() if n >= MIN_DOCS}
    chosen = sorted((w for w, x in apart.items() if x >= LEAST_Z), key=lambda w: (-apart[w], w))[:MAX_WORDS]
    number = {w: i for i, w in enumerate(chosen)}
    doc, flat, owner = array("q"), array("q"), array("q")
    for d, t in enumerate(texts):
        for a, b in sentences(t):
            known = [number[f] for w in set(_WORD.findall(t[a:b].lower())) for f in features(w) if f in number]
            flat.extend(known)
            owner.extend([len(doc)] * len(known))
            doc.append(d)
    doc, flat, owner = np.array(doc), np.array(flat), np.array(owner)
    n, k = len(doc), len(chosen)
    w, leak_logit = np.zeros(k + 1), -3.0
    w[k] = -4.0  # bias
    m, v = np.zeros(k + 2), np.zeros(k + 2)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[flat], n) + w[k]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-leak_logit))
        log_rest = np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)) + np.log1p(-leak)
        p = np.maximum(-np.expm1(log_rest), 1e-9)
        pull = np.where(y == 1, -(1 - p) / p, 1.0)  # d loss / d(-log_rest)
        ds = pull[doc] * s / len(y)
        g = np.append(np.bincount(flat, ds[owner], k) + decay * w[:k], [ds.sum(), (pull * leak).sum() / len(y)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8) * (1 - t / (steps + 1))
        w -= step[:k + 1]
        leak_logit -= step[k + 1]
    return Model({x: float(w[i]) for x, i in number.items()}, float(w[k]), float(1 / (1 + np.exp(-leak_logit))))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents that are not held out: of each, all if there are at most ``rows``, else about
    that many, chosen by a hash of the id."""
    own = (labels.filter(~held_out()).filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
           .agg(F.count(F.lit(1)).alias("n"), F.max("toxic").alias("toxic")).filter("n = 1"))
    share = min(1.0, rows / max(own.count(), 1))
    chosen = own.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = (docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
           .orderBy("doc_id", F.xxhash64("text")).limit(2 * rows).collect())
    return fit([r.text for r in got], [int(r.toxic > 0) for r in got])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; ``spans``: the offending sentences of documents
    predicted toxic."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(
        T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])

    @F.pandas_udf(kind)
    def judge(texts: pd.Series) -> pd.DataFrame:
        scores = [model.score(t) for t in texts]
        spans = [[{"start": a, "end": b} for a, b in model.spans(t)] if s >= threshold else []
                 for t, s in zip(texts, scores)]
        return pd.DataFrame({"score": scores, "spans": spans})
    read = docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col)).alias("r"))
    return read.select("doc_id", held_out().alias("held_out"), F.col("r.score").alias("score"),
                       (F.col("r.score") >= threshold).cast("int").alias("predicted"), F.col("r.spans").alias("spans"))
