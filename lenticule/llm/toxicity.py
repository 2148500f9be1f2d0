"""Toxicity by multiple-instance learning: sentences are instances, only whole documents have labels.

A sentence's probability is logistic in the words it holds, and a document's is the noisy-or of its sentences: it is toxic
unless every sentence is harmless. The likelihood of the document labels trains the word weights, so the model learns by itself
which sentences make a document toxic, and names them.

Training takes a bounded sample of labelled rows, chosen by a hash of the key (``train_rows`` rows with texts of at most
``train_bytes``); scoring reads every row and whole texts. The weights come from words of the sample only and so are bounded too.
A last logistic step on the sample puts the noisy-or on the scale of probabilities.

Defined results: null and empty texts have no sentences and get the score of no evidence; with no usable labels of both kinds every
score is 0; repeated rows get equal scores; labels that are null, and those of a document that is labelled both ways, do not count; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))
_SENTENCE = re.compile(rb"[^.!?\n]*[.!?\n]+|[^.!?\n]+")


@dataclass(frozen=True)
class ToxicityConfig:
    """``sparsity`` is the L1 price of a weight, in units of one document's log-likelihood."""

    train_rows: int = 6000
    train_bytes: int = 20_000
    least_documents: int = 4
    epochs: int = 100
    rate: float = 0.25
    sparsity: float = 0.5
    bias: float = -8.0
    prefixes: tuple[int, ...] = (4, 5, 6)


class _WordWeights(dict):
    """Word to weight, by way of its features; memoised up to a bound."""

    def __init__(self, weights: dict[str, float], prefixes: tuple[int, ...], most: int = 100_000):
        super().__init__()
        self.weights, self.prefixes, self.most = weights, prefixes, most

    def __missing__(self, word: bytes) -> float:
        total = sum(self.weights.get(f, 0.0) for f in features_of(word, self.prefixes))
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = total
        return total


def features_of(word: bytes, prefixes: tuple[int, ...]) -> list[str]:
    """The word itself and its beginnings, which many forms of one stem share."""
    text = word.decode("utf-8", "replace")
    return [text, *(f"{text[:n]}*" for n in prefixes if len(text) > n)]


@dataclass
class ToxicityModel:
    """Feature weights (none below 0), bias of a sentence, slope and shift of a document's logit."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    slope: float = 1.0
    shift: float = 0.0
    prefixes: tuple[int, ...] = ()
    trained: bool = False

    def word_weights(self) -> _WordWeights:
        return _WordWeights(self.weights, self.prefixes)

    def sentences(self, text: bytes, weight: _WordWeights) -> list[tuple[int, int, float]]:
        """Byte range and logit of each sentence with words that count; all others are harmless."""
        out = []
        for m in _SENTENCE.finditer(text):
            total = sum([weight[w] for w in set(m[0].translate(_TABLE).split())])
            if total > 0:
                out.append((m.start(), m.end(), self.bias + total))
        return out

    def document(self, logits: list[float]) -> float:
        """Score from the logits of the sentences with words that count."""
        if not self.trained:
            return 0.0
        harmless = -np.logaddexp(0, np.array([self.bias, *logits])).sum()  # log of the probability that no sentence is toxic
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit_of(harmless) + self.shift, -30, 30))))


def _logit_of(harmless: np.ndarray | float) -> np.ndarray | float:
    """Logit of 1 - exp(harmless)."""
    h = np.minimum(harmless, -1e-12)
    return np.log(-np.expm1(h)) - h


def train(texts: list[bytes], labels: np.ndarray, c: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    if len(set(labels.tolist())) < 2:
        return ToxicityModel()
    once: dict[bytes, bytes] = {}  # one object for each word, however often it occurs
    split = [[[once.setdefault(w, w) for w in m[0].translate(_TABLE).split()] for m in _SENTENCE.finditer(t)] for t in texts]
    known = {w: features_of(w, c.prefixes) for w in once}
    often, toxic = Counter(), Counter()
    for d, y in zip(split, labels, strict=True):
        found = {f for w in {w for s in d for w in s} for f in known[w]}
        often.update(found)
        if y:
            toxic.update(found)
    base = labels.mean()
    # evidence is for toxicity only, so features that are not clearly commoner among toxic texts get no weight
    code = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= c.least_documents and toxic[f] > base * n + 3 * (base * n) ** 0.5))}
    owner, feats, of_feat = [], [], []
    for d, sentences in enumerate(split):
        for words in sentences:
            on = {code[f] for w in set(words) for f in known[w] if f in code}
            if on:
                feats += on
                of_feat += [len(owner)] * len(on)
                owner.append(d)
    owner, feats, of_feat = (np.array(x, dtype=np.int64) for x in (owner, feats, of_feat))
    y, n = labels.astype(float), len(owner)
    theta, m, v = np.zeros(len(code)), np.zeros(len(code)), np.zeros(len(code))
    silent = -np.logaddexp(0, c.bias)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        z = c.bias + np.bincount(of_feat, theta[feats], n)
        return z, silent + np.bincount(owner, -np.logaddexp(0, z), len(y))

    for step in range(1, c.epochs + 1):
        z, harmless = forward()
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        pull = np.exp(np.clip(-_logit_of(harmless), -30, 12))  # (1 - P) / P
        g = np.where(y[owner] == 1, -pull[owner] * p, p)
        grad = np.bincount(feats, g[of_feat], len(code)) + c.sparsity
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = c.rate * min(1.0, 2 * (1 - step / (c.epochs + 1)))
        theta = np.maximum(0.0, theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
    x = np.clip(_logit_of(forward()[1]), -30, 30)
    slope, shift = platt(x, y)
    return ToxicityModel({f: float(theta[i]) for f, i in code.items() if theta[i] > 0.05}, c.bias, slope, shift, c.prefixes, True)


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a logistic regression of y on x, by Newton steps, with smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ design, -30, 30)))
        grad = design @ (p - target) + ridge * a
        hess = (design * (p * (1 - p) + 1e-9)) @ design.T + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, usable: Column, key: str, text: str, rows: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled texts, each of at most ``most_bytes``, chosen by a hash of the key among all such texts.

    ``usable`` filters the labels. A key that is labelled both ways is left out; of several texts of a key, the smallest counts.
    """
    marks = labels.filter(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other"))
    short = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.octet_length("t") <= most_bytes)
    known = marks.filter("y = other").select("k", "y").join(short.select("k").distinct(), "k", "left_semi")
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(rows).collect()  # bounded by ``rows``
    if not chosen:
        return [], np.empty(0)
    few = df.sparkSession.createDataFrame([tuple(r) for r in chosen], f"k {df.schema[key].dataType.simpleString()}, y int")
    found = short.join(F.broadcast(few), "k").groupBy("k", "y").agg(F.min("t").alias("t")).toPandas().sort_values("k")
    return [t.encode("utf-8") for t in found["t"]], found["y"].to_numpy()


def score_documents(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", sure: float = 0.0) -> DataFrame:
    """The key, score and offending: (start, end, score) of sentences with a logit over ``sure``; code points, end exclusive."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.word_weights()
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode("utf-8")
                found = model.sentences(raw, weight)
                scores.append(model.document([z for *_, z in found]))
                bad, at, chars = [], 0, 0
                for s, e, z in found:
                    if z > sure:
                        chars += len(raw[at:s].decode("utf-8"))
                        end = chars + len(raw[s:e].decode("utf-8"))
                        bad.append({"start": chars, "end": end, "score": float(1 / (1 + np.exp(-min(z, 30))))})
                        at, chars = e, end
                spans.append(bad)
            shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, shape)], names=[key, "score", "offending"])

    return map_rows(df.select(key, text), run, f"`{key}` {kind}, score double, offending array<struct<start:int,end:int,score:double>>")


def keep_below(df: DataFrame, model: ToxicityModel, limit: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` with a score below ``limit``, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.word_weights()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            keep = [model.document([z for *_, z in model.sentences((t.as_py() or "").encode("utf-8"), weight)]) < limit for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(df, run, df.schema)
