"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. What speaks for a line is linear in its own features and those of the lines next to it; what speaks for a
pair of neighbouring labels is a weight for each pair. Training maximises the conditional likelihood of line labels, which each line
takes from its document. Forward-backward gives every line's marginal, and the mean of the marginals, weighted by the lines' lengths,
is the document's quality; a last logistic step on the sample puts it on the scale of probabilities.

Training takes a bounded sample of labelled rows, chosen by a hash of the key (``train_rows`` rows with texts of at most
``train_bytes``, up to ``train_lines`` lines in all); scoring reads every row and whole texts.

Defined results: a text without lines (null, empty, only white space) counts as one line without features; with no usable labels of
both kinds every score is 0.5; repeated rows get equal scores; labels that are null, and those of a document that is labelled both ways, do
not count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows
from .toxicity import platt

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*|<>{}[]\\^~=_@+/"
_MARKS = b".,;:!?"
FEATURES = 12


@dataclass(frozen=True)
class QualityConfig:
    train_rows: int = 5000
    train_bytes: int = 20_000
    train_lines: int = 400_000
    batch_cells: int = 16_384
    epochs: int = 200
    rate: float = 0.1
    penalty: float = 1.0


def lines_of(text: str | None) -> list[bytes]:
    return [x for x in (text or "").encode("utf-8").split(b"\n") if x.strip()]


def line_features(line: bytes) -> list[float]:
    n = len(line)
    share = lambda chars: (n - len(line.translate(None, chars))) / n
    words = line.split()
    k = len(words)
    letters = share(_LETTERS)
    return [
        1.0,
        share(_UPPER) / (letters + 0.05),
        min(1.0, 4 * share(_SYMBOLS)),
        min(1.0, 4 * share(_MARKS)),
        min(1.0, 4 * line.count(b"!") / n),
        share(_DIGITS),
        len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        min(1.0, n / k / 20),
        min(1.0, math.log1p(k) / 6),
        1.0 if line[-1:] in (b".", b"!", b"?") else 0.0,
        1.0 - letters,
    ]


def chain_features(lines: list[bytes]) -> np.ndarray:
    """A row for each line: its features, and those of the line before and after (zeros at the ends)."""
    own = np.array([line_features(x) for x in lines]) if lines else np.zeros((1, FEATURES))
    none = np.zeros((1, FEATURES))
    return np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])], axis=1)


@dataclass
class QualityModel:
    """Weights for the label good, scores of pairs of labels (bad, good), slope and shift of a document's logit."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * FEATURES))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, lines: list[bytes]) -> list[float]:
        """Probability of good for each line, by forward-backward with scaled messages."""
        odds = np.exp(np.clip(chain_features(lines) @ self.weights, -50, 50)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.pairs - self.pairs.max()).tolist()
        ahead, b, g = [], 0.5, 0.5
        for i, o in enumerate(odds):
            if i:
                b, g = b * bb + g * gb, b * bg + g * gg
            g *= o
            total = b + g
            b, g = b / total, g / total
            ahead.append((b, g))
        out, b, g = [0.0] * len(odds), 1.0, 1.0
        for i in range(len(odds) - 1, -1, -1):
            fb, fg = ahead[i]
            out[i] = fg * g / (fb * b + fg * g)
            o = odds[i]
            b, g = bb * b + bg * g * o, gb * b + gg * g * o
            total = b + g
            b, g = b / total, g / total
        return out

    @staticmethod
    def logit(p: list[float], lines: list[bytes]) -> float:
        """Of the mean of the marginals, weighted by the lines' lengths."""
        mean = sum(x * len(n) for x, n in zip(p, lines, strict=True)) / sum(map(len, lines)) if lines else p[0]
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return math.log(mean / (1 - mean))

    def score(self, p: list[float], lines: list[bytes]) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.logit(p, lines) + self.shift, -30), 30)))


def _expected(x: np.ndarray, mask: np.ndarray, w: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good, (documents, lines), and expected pair counts of the masked chains, all documents at once."""
    d, t, _ = x.shape
    unary = np.zeros((d, t, 2))
    unary[:, :, 1] = x @ w
    ahead, back = np.zeros((d, t, 2)), np.zeros((d, t, 2))
    ahead[:, 0] = unary[:, 0]
    for i in range(1, t):
        ahead[:, i] = unary[:, i] + np.logaddexp(ahead[:, i - 1, :1] + pairs[0], ahead[:, i - 1, 1:] + pairs[1])
    for i in range(t - 2, -1, -1):
        nxt = unary[:, i + 1] + back[:, i + 1]
        new = np.logaddexp(pairs[:, 0] + nxt[:, :1], pairs[:, 1] + nxt[:, 1:])
        back[:, i] = np.where(mask[:, i + 1, None], new, 0.0)
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -50, 50)))
    joint = ahead[:, :-1, :, None] + pairs + (unary + back)[:, 1:, None, :]
    joint = np.exp(joint - joint.max(axis=(2, 3), keepdims=True))
    joint = joint / joint.sum(axis=(2, 3), keepdims=True) * mask[:, 1:, None, None]
    return good * mask, joint.sum(axis=(0, 1))


def _like_lengths(sizes: list[int], cells: int) -> Iterator[np.ndarray]:
    """Chains of like length together; padded to the longest, a batch has at most ``cells`` lines, or one chain."""
    own: list[int] = []
    for i in np.argsort(sizes, kind="stable").tolist():
        if own and (len(own) + 1) * sizes[i] > cells:
            yield np.array(own)
            own = []
        own.append(i)
    yield np.array(own)


def train(texts: list[bytes], labels: np.ndarray, c: QualityConfig = QualityConfig()) -> QualityModel:
    if len(set(labels.tolist())) < 2:
        return QualityModel()
    split = [lines_of(t.decode("utf-8")) for t in texts]
    held = np.cumsum([max(1, len(x)) for x in split]) <= c.train_lines
    split, labels = [x for x, h in zip(split, held, strict=True) if h], labels[held]
    if len(set(labels.tolist())) < 2:
        return QualityModel()
    batches = []
    for own in _like_lengths([max(1, len(x)) for x in split], c.batch_cells):
        feats = [chain_features(split[i]) for i in own]
        x = np.zeros((len(own), max(map(len, feats)), 3 * FEATURES))
        mask = np.zeros(x.shape[:2], dtype=bool)
        for row, f in enumerate(feats):
            x[row, : len(f)], mask[row, : len(f)] = f, True
        y = labels[own].astype(float)[:, None] * mask
        steps = mask[:, 1:].sum(axis=1)
        seen = np.array([[(steps * (1 - y[:, 0])).sum(), 0.0], [0.0, (steps * y[:, 0]).sum()]])
        batches.append((x, mask, y, seen))
    total = sum(m.sum() for _, m, _, _ in batches)
    theta = np.zeros(3 * FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, c.epochs + 1):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        grad = c.penalty * theta
        for x, mask, y, seen in batches:
            good, joint = _expected(x, mask, w, pairs)
            grad[:-4] += np.einsum("dt,dtf->f", good - y, x)
            grad[-4:] += (joint - seen).ravel()
        grad /= total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = c.rate * min(1.0, 2 * (1 - step / (c.epochs + 1)))
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = QualityModel(theta[:-4], theta[-4:].reshape(2, 2))
    model.slope, model.shift = platt(np.array([model.logit(model.marginals(x), x) for x in split]), labels.astype(float))
    return model


def score_documents(df: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, score and n_bad_lines (lines that are rather bad than good)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, bad = [], []
            for value in batch.column(1):
                lines = lines_of(value.as_py())
                p = model.marginals(lines)
                bad.append(sum(x < 0.5 for x in p) if lines else 0)
                scores.append(model.score(p, lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(bad, pa.int32())], names=[key, "score", "n_bad_lines"])

    return map_rows(df.select(key, text), run, f"`{key}` {kind}, score double, n_bad_lines int")
