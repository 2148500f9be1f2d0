"""URL filter: listed rules first, then the ratio of two character language models.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and the longest rule that fits decides. The urls
that rules decide are the accepted and rejected ones that train two variable-order Markov models of their characters, from scheme to
fragment. The probability
of a character mixes all orders, each smoothed towards the one below. A url that no rule decides is judged by the difference of its two
log-likelihoods, divided by its length, against a threshold that is calibrated on decided urls kept out of training.

Counts cover every decided url and are exact: a context and the character after it are packed into one long, and the counts of all
of them are a distributed table that grows with the urls. Scores come from joins: a character's probability depends on it and the
characters before it alone, so each distinct run of them is looked up once in every order, and the urls then look up their runs.
Nothing but the two totals and the cells of the calibration comes to the driver.

Defined results: null urls and urls without ``://`` have an empty host and path; a null url is judged as the empty string. Where training
sees only one of the classes, or none, all scores are 0 and undecided urls are allowed; where calibration does, the threshold is 0.
Repeated rows get equal verdicts; an empty table gives an empty result; other columns are ignored, and the key may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


@dataclass(frozen=True)
class MarkovConfig:
    order: int = 5
    mass: float = 1.5
    holdout: int = 5
    bins: int = 1024
    span: float = 8.0


#: Scores are summed in whole steps of this size, so that the order of the rows does not matter.
STEP = 2.0**-32


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    df = df.withColumn("__rest", rest)
    df = df.withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), upper, lower))
    return df.withColumn("path", F.regexp_extract(F.substr("__rest", F.length("host") + 1), r"^[^?#]*", 0)).drop("__rest")


def with_rule(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add rule (text of the longest rule that fits host and path, else null) and rule_verdict."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest comes last and so is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found, verdict = F.when(fits, r.text).otherwise(found), F.when(fits, r.verdict).otherwise(verdict)
    return df.withColumn("rule", found).withColumn("rule_verdict", verdict)


#: Characters that are turned into grams at a time.
STRETCH = 1 << 18


def _stretches(texts: list[bytes], order: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of pieces of bounded length, with their texts' numbers. Each text starts with ``order`` marks and ends with one, and each
    piece starts with the ``order`` characters before its first."""
    owners, pieces, held = [], [], 0
    for i, t in enumerate(texts):
        marked = b"\x00" * order + t + b"\x01"
        for at in range(0, len(t) + 1, STRETCH):
            piece = marked[at : at + order + STRETCH]
            if held + len(piece) > 2 * STRETCH:
                yield owners, pieces
                owners, pieces, held = [], [], 0
            owners.append(i)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield owners, pieces


def _grams(owners: list[int], pieces: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each character with the ``order`` ones before it, the last in the lowest byte, and each character's text."""
    sizes = np.array([len(p) - order for p in pieces], dtype=np.int64)
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(int(sizes.sum())) + (piece + 1) * order
    gram = np.zeros(len(place), dtype=np.int64)
    for k in range(order + 1):
        gram |= flat[place - k] << (8 * k)
    return gram, np.array(owners)[piece]


def _level(k: int) -> tuple[int, int]:
    """What an order keeps of a gram, and its mark: orders have keys of their own."""
    return (1 << 8 * (k + 1)) - 1, k << 56


def _tally(df: DataFrame, name: str, c: MarkovConfig) -> DataFrame:
    """For rows of (``name``, text): ``name``, gram and n, how often the batch's texts of that name have it."""
    kind = df.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            for owners, pieces in _stretches([t.as_py().encode("utf-8") for t in batch.column(1)], c.order):
                gram, owner = _grams(owners, pieces, c.order)
                whose = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                order = np.lexsort((gram, whose))
                gram, whose = gram[order], whose[order]
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (whose[1:] != whose[:-1])]))
                n = np.diff(np.append(first, len(gram)))
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(whose[first])), pa.array(gram[first]), pa.array(n)], names=[name, "gram", "n"])

    return map_rows(df.select(name, "text"), run, f"`{name}` {kind}, gram long, n long")


def count(decided: DataFrame, c: MarkovConfig) -> DataFrame:
    """(key, a, r): how often accepted and rejected texts have each character in each context, over all rows of (text, accepted)."""
    longest = _tally(decided, "accepted", c).groupBy("gram").agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r"))
    return _levels(longest, c).groupBy("key").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def _levels(grams: DataFrame, c: MarkovConfig) -> DataFrame:
    """Each row once for every order k, with the order's key."""
    keys = [F.col("gram").bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(mark)) for keep, mark in map(_level, range(c.order + 1))]
    return grams.select("*", F.posexplode(F.array(*keys)).alias("k", "key"))


def ratios(grams: DataFrame, counts: DataFrame, c: MarkovConfig) -> DataFrame:
    """(gram, steps): log-probability of the last character in the accepted model less that in the rejected one, for distinct grams."""
    bare = F.col("key").bitwiseAND(F.lit(~255))
    contexts = counts.groupBy(bare.alias("context")).agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
    rows = _levels(grams, c).withColumn("context", bare).join(counts, "key", "left").join(contexts, "context", "left")
    at = lambda name, k: F.coalesce(F.max(F.when(F.col("k") == k, F.col(name))), F.lit(0))
    names = [f"{name}_{k}" for name in ("a", "r", "all_a", "all_r") for k in range(c.order + 1)]
    wide = rows.groupBy("gram").agg(*(at(*n.rsplit("_", 1)).alias(n) for n in names))
    logs = []
    for own in ("a", "r"):
        p = F.lit(1 / 257)
        for k in range(c.order + 1):
            p = (F.col(f"{own}_{k}") + c.mass * p) / (F.col(f"all_{own}_{k}") + c.mass)
        logs.append(F.log(p))
    return wide.select("gram", F.round((logs[0] - logs[1]) / STEP).cast("long").alias("steps"))


def score(texts: DataFrame, counts: DataFrame, c: MarkovConfig) -> DataFrame:
    """(text, score) for distinct texts: log-likelihood of the accepted model less that of the rejected one, per character."""
    texts = materialise(texts.withColumn("id", F.monotonically_increasing_id()), "url_texts")
    grams = materialise(_tally(texts, "id", c), "url_grams")
    each = ratios(grams.select("gram").distinct(), counts, c)
    sums = grams.join(each, "gram").groupBy("id").agg((F.sum(F.col("steps") * F.col("n")) * STEP / F.sum("n")).alias("score"))
    return texts.join(sums, "id").select("text", "score")


def calibrate(scored: DataFrame, config: MarkovConfig) -> float:
    """The threshold between rows of (accepted, score)."""
    width = 2 * config.span / config.bins
    cell = F.least(F.greatest(F.floor((F.col("score") + config.span) / width), F.lit(0)), F.lit(config.bins - 1)).cast("int")
    cells = scored.groupBy("accepted", cell.alias("cell")).agg(F.count("*").alias("n")).collect()
    seen = np.zeros((2, config.bins))
    for r in cells:
        seen[int(r["accepted"]), r["cell"]] += r["n"]
    if not (seen.sum(axis=1) > 0).all():
        return 0.0
    share = seen / seen.sum(axis=1, keepdims=True)
    # share of rejected below a cut plus share of accepted from it on; of equal cuts, the middle one
    good = np.concatenate([[0], np.cumsum(share[0])]) + 1 - np.concatenate([[0], np.cumsum(share[1])])
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(best[len(best) // 2] * width - config.span)


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, config: MarkovConfig = MarkovConfig()) -> DataFrame:
    """One row for each row: key, host, path, rule, verdict, score. Every ``holdout``-th decided url, by a hash of it, is kept for calibration."""
    rows = df.select(F.col(key).alias("__key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("text"))
    parts = with_rule(with_parts(rows, "text"), rules)
    decided = parts.filter("rule is not null").select("text", (F.col("rule_verdict") == "allow").alias("accepted"))
    apart = F.pmod(F.xxhash64("text"), F.lit(config.holdout)) == 0
    counts = materialise(count(decided.filter(~apart), config), "url_counts")
    total = counts.agg(F.sum("a"), F.sum("r")).first()
    if not all(total):
        out = parts.select("__key", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
        return out.toDF(key, *out.columns[1:])
    scored = materialise(score(parts.select("text").distinct(), counts, config), "url_scores")
    threshold = calibrate(decided.filter(apart).join(scored, "text"), config)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    out = parts.join(scored, "text").select("__key", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score")
    return out.toDF(key, *out.columns[1:])
