"""Near copies: texts that share at least four fifths of their five-word shingles, and the groups that such pairs form.

SimHash fingerprints of the shingles and the joined tries propose the first links; they settle the large groups cheaply, but no
budget of bits covers a similarity. So a prefix join completes them: with the shingles of every text in one common order, two texts
as similar as that share one of the first ``n - ceil(0.8 n) + 1`` shingles of each, and of the shorter one even one of the first
``n - ceil(8/9 n) + 1``. All pairs that do, with enough shingles left from there on, and that no accepted link connects yet, are
candidates. Of these, pairs are left out whose marks differ in more bits than so similar sets can differ in shingles; the marks of a group
bound those of its members, so that groups far apart never meet. Every proposed link, wherever it comes from, is accepted only by the Jaccard similarity of the whole sets of shingles, in
integers; shingles are compared by 64-bit hashes.

The order puts shingles that many texts share last, by counts in a table of fixed size. The table decides the order alone: any order
gives the same groups, and a poor one only more candidates.

Defined results: a text of fewer than five words is one shingle; texts without words, null included, are copies of each other; rows
with a null key are kept and belong to no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import give_back, map_rows, materialise, only, without
from .graph import components

WORDS = 5
SHARE = (4, 5)
SLOTS = 1 << 20
HEAVY = 4096
#: Words of 64 bits of the mark that goes with each row of the prefix join.
FOLDS = 8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted; words are told apart as for fingerprints."""
    parts = (text or "").encode("utf-8").lower().split()
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(p, 42) for p in parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(own))
    total = np.full(max(len(own) - words, 0) + 1, width, dtype=np.uint64)
    for k in range(width):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(total)]
    return np.unique(total)


def _heavy(df: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the commonest shingles, sorted, and their counts; each task names at most ``HEAVY`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 512):
                found = np.concatenate([shingles(t.as_py(), words) for t in texts[at : at + 512]])
                np.add.at(seen, (found % np.uint64(SLOTS)).astype(np.int64), 1)
        top = np.argpartition(seen, -HEAVY)[-HEAVY:]
        top = top[seen[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(seen[top])], names=["slot", "c"])

    sums = map_rows(df.select(text), run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "slot").limit(SLOTS // 8).toPandas().sort_values("slot")
    return sums["slot"].to_numpy(dtype=np.int64), sums["c"].to_numpy(dtype=np.int64)


def mark(own: np.ndarray, bits: int | None = None) -> bytes:
    """For each of a power of two of bits, by default at least as many as there are shingles, whether an odd number of them falls on it."""
    bits = bits or max(64, 1 << max(len(own) - 1, 0).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """How many shingles at least are in one of two sets alone, by their marks: every odd bit of the difference is one."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sketches(df: DataFrame, key: str, text: str, words: int, share: tuple[int, int]) -> DataFrame:
    """(node, n, mark, fold, head): the number of shingles, their mark, one of ``FOLDS`` words, and those at the head of the common order."""
    held = df.sparkSession.sparkContext.broadcast(_heavy(df, text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                head, marks, folds, total = [], [], [], []
                for t in batch.column(1)[at : at + 256]:
                    own = shingles(t.as_py(), words)
                    slot = (own % np.uint64(SLOTS)).astype(np.int64)
                    place = np.minimum(np.searchsorted(slots, slot), max(len(slots) - 1, 0))
                    common = np.where(slots[place] == slot, counts[place], 0) if len(slots) else np.zeros(len(own), dtype=np.int64)
                    size = len(own) - -(-share[0] * len(own) // share[1]) + 1
                    head.append(own[np.lexsort((own, common))[:size]])
                    marks.append(mark(own))
                    folds.append(np.frombuffer(mark(own, 64 * FOLDS), np.int64))
                    total.append(len(own))
                ends = np.cumsum([0, *map(len, head)]).astype(np.int32)
                heads = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(head).view(np.int64)))
                fold = pa.ListArray.from_arrays(pa.array(np.arange(len(folds) + 1, dtype=np.int32) * FOLDS), pa.array(np.concatenate(folds)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 256], pa.array(total, pa.int32()), pa.array(marks, pa.binary()), fold, heads], names=["node", "n", "mark", "fold", "head"]
                )

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), run, f"node {kind}, n int, mark binary, fold array<long>, head array<long>")


def _similar(df: DataFrame, pairs: DataFrame, sketches: DataFrame, key: str, text: str, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles have at least this Jaccard similarity.

    A pair whose marks differ in more bits than sets as similar as that can differ in shingles is none, so no pair is lost by
    them; texts move for the others only.
    """
    low, high = share
    kind = df.schema[key].dataType.simpleString()

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], dtype=np.int64)
            both = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(5).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array((high + low) * apart <= (high - low) * both))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingles(x.as_py(), words), shingles(y.as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(high * both >= low * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    marks = sketches.select("node", "n", "mark")
    marked = pairs.join(marks.toDF("a", "n", "x"), "a").join(marks.toDF("b", "m", "y"), "b").select("a", "b", "x", "y", "n", "m")
    left = materialise(map_rows(marked, possible, f"a {kind}, b {kind}").distinct(), "near_left")
    texts = only(df.select(key, text), key, left.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    both = left.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return map_rows(both, judge, f"a {kind}, b {kind}").distinct()


def _folds(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(FOLDS)]


def _apart(x: tuple[str, str], y: tuple[str, str]) -> str:
    """SQL of the bits that differ at least between two groups of texts, each given by the bits that all and that any of its marks hold.

    One text is a group with the same bits twice; between two texts it is the number of differing bits, hence a lower bound of the
    shingles that are in one of them alone.
    """
    (all_x, any_x), (all_y, any_y) = x, y
    return "(" + " + ".join(f"bit_count(({all_x}{i} & ~{any_y}{i}) | ({all_y}{i} & ~{any_x}{i}))" for i in range(FOLDS)) + ")"


def _opened(heads: DataFrame, label: DataFrame, early: str) -> DataFrame:
    """The rows of shingles that texts of different groups share, with the texts' groups."""
    now = heads.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component").withColumn("early", F.expr(early))
    several = now.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("early").alias("any")).filter("lo <> hi and any").select("h")
    return now.join(several, "h")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(node, component) for every key that has a near copy; the component is the smallest key that it reaches."""
    df = df.select(key, text).filter(F.col(key).isNotNull())
    low, high = share
    sketches = materialise(_sketches(df, key, text, words, share), "near_sketches")
    heads = sketches.select("node", "n", F.posexplode("head").alias("pos", "h"))
    shared = heads.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    heads = materialise(heads.join(shared, "h"), "near_heads")
    prints = materialise(simhash.fingerprints(df, key, text, words), "near_prints")
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    near = simhash.near_links(least.select("fp"))
    ends = [least.toDF(side, f"least_{side}") for side in ("a", "b")]
    tries = near.join(ends[0], "a").join(ends[1], "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    pairs = prints.join(least, "fp").select(F.col("least").alias("a"), F.col(key).alias("b")).union(tries).filter("a <> b")

    def accepted(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "near_pairs")
        return _similar(df, pairs, sketches, key, text, words, share)

    # each shingle's texts to one of them, two links for each text: what these and the tries connect has no pairs later
    hub = heads.groupBy("h").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "h")).alias("hub"))
    met = heads.join(hub, "h").filter(f"{high} * least(n, hub.n) >= {low} * greatest(n, hub.n)")
    met = met.groupBy("node").agg(F.array(F.min("hub.node"), F.max("hub.node")).alias("hubs"))
    first = materialise(accepted(pairs.union(met.select(F.col("node").alias("a"), F.explode("hubs").alias("b")))), "near_links")
    # groups of a shingle meet, and members of different groups only; of two texts, the shorter one has the first shared shingle even earlier
    early = f"pos <= n - ({2 * low} * n + {low + high - 1}) div {low + high}"
    folds = sketches.select("node", *(F.col("fold")[i].alias(g) for i, g in enumerate(_folds("g"))))
    now = materialise(_opened(heads, components(first), early).join(folds, "node").select("h", "node", "n", "pos", "label", "early", *_folds("g")), "near_open")
    # once more each shingle's texts to one of them, by other choice, where the groups differ and the marks allow it
    few = lambda apart, sizes: f"{high + low} * {apart} <= {high - low} * ({sizes})"
    hub = now.groupBy("h").agg(F.min_by(F.struct("node", "n", "label", *_folds("g")), F.xxhash64("h", "node")).alias("hub"))
    hub = hub.select("h", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.col("hub.label").alias("r"), *(F.col(f"hub.g{i}").alias(y) for i, y in enumerate(_folds("y"))))
    met = now.join(hub, "h").filter(f"label <> r and {high} * least(n, m) >= {low} * greatest(n, m)").filter(few(_apart(("g", "g"), ("y", "y")), "n + m"))
    met = met.groupBy("node").agg(F.array(F.min("b"), F.max("b")).alias("hubs"))
    first = materialise(first.union(accepted(met.select(F.col("node").alias("a"), F.explode("hubs").alias("b")))), "near_links")
    now = materialise(_opened(now.drop("label", "early"), components(first), early).select("h", "node", "n", "pos", "label", "early", *_folds("g")), "near_open")
    early = now.filter("early").drop("early")
    give_back(df.sparkSession)

    def reach(*bits: str) -> list[Column]:
        """Of a group: sizes, most that can be shared from here on, and the bits that all and that any of its marks hold."""
        both = [f(g).alias(f"{b}{i}") for f, b in zip((F.bit_and, F.bit_or), bits, strict=True) for i, g in enumerate(_folds("g"))]
        return [F.min("n"), F.max("n"), F.max(F.col("n") - F.col("pos")), *both]

    short = early.groupBy("h", "label").agg(*reach("c", "d")).toDF("h", "l", "n0", "n1", "s", *_folds("c"), *_folds("d"))
    long = now.groupBy("h", "label").agg(*reach("e", "f")).toDF("h", "r", "m0", "m1", "t", *_folds("e"), *_folds("f"))
    meet = short.join(long, "h").filter(f"l <> r and n0 <= m1 and {high} * n1 >= {low} * m0 and {low + high} * least(s, t) >= {low} * (n0 + m0)")
    meet = meet.filter(few(_apart(("c", "d"), ("e", "f")), "n1 + m1")).select("h", "l", "r", "m0", "m1", "t", *_folds("e"), *_folds("f"))
    # a member goes on to the groups only that its own size, place and mark allow
    met = meet.join(early.toDF("h", "a", "n", "p", "l", *_folds("x")), ["h", "l"]).filter(f"n <= m1 and {high} * n >= {low} * m0 and {low + high} * least(n - p, t) >= {low} * (n + m0)")
    met = met.filter(few(_apart(("x", "x"), ("e", "f")), "n + m1")).select("h", "r", "a", "n", "p", *_folds("x"))
    met = met.join(now.drop("early").toDF("h", "b", "m", "q", "r", *_folds("y")), ["h", "r"])
    # at the first shared one what is left suffices, so a pair that is due passes there
    met = met.filter(f"n <= m and {high} * n >= {low} * m and {low + high} * least(n - p, m - q) >= {low} * (n + m)").filter(few(_apart(("x", "x"), ("y", "y")), "n + m"))
    left = met.select("a", "b").distinct()
    return components(materialise(first.union(accepted(left)), "near_links"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its group, with all their columns."""
    gone = near_copies(df, key, text, words, share).filter("node <> component").select(F.col("node").alias("id"))
    return without(df, key, materialise(gone, "near_gone"))
