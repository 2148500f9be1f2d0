"""SimHash fingerprints and their near pairs, by a self-join of binary tries.

Fingerprints within ``BUDGET`` bits agree on at least one of ``BUDGET + 1`` equal slices of their bits, and so again for the bits
that are left. So for each slice the
bits are rotated until that slice comes first, and a binary trie over the rotated values is joined with itself below each
node at the depth of the slice: pairs of nodes descend together, differing bits add up, and a pair of nodes is given up as
soon as the sum exceeds the budget, or when everything below both is linked already. Only distinct fingerprints enter.

The join hands on a spanning forest of the links that it finds, never all pairs of a group; ``components`` completes it.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link like any other; repeated
rows share a fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise
from .graph import components

BITS = 64
BUDGET = 3
SHINGLE = 3


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash over word shingles, repeats included: a bit is set where more than half of the hashes have it set."""
    parts = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only 20 and 09-0D split
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, dtype=np.int64), len(last)
    for at in range(0, n, 16384):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(first[at : at + 16384], last[at : at + 16384], strict=False)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """The key and ``fp``, the fingerprint as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[key, "fp"])

    return map_rows(df.select(key, text), run, f"`{key}` {kind}, fp long")


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking positions ``a`` and ``b``: every position gets the smallest position that it reaches."""
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
        if (label[a] == label[b]).all():
            return label


def trie_links(values: np.ndarray, roots: np.ndarray, depth: int, budget: int = BUDGET, frontier: int = 1 << 20) -> np.ndarray:
    """Join a forest of binary tries with themselves; label every value with the smallest position that it is linked with.

    ``values`` are unsigned 64-bit integers, sorted within each root; ``roots`` holds the bounds of the roots (all values of
    a root share their first ``depth`` bits). A node is a range of sorted values, so its two children are found from running
    counts of ones. Small budgets come first: what they link lets the larger ones pass over whole pairs of nodes. At most
    about ``frontier`` pairs of nodes are expanded at once, deepest first, which bounds the memory.
    """
    n = len(values)
    label = np.arange(n)
    ones = {}
    for allowed in range(1, budget + 1):
        same = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if n else label
        lo, hi = roots[:-1], roots[1:]
        many = hi - lo > 1
        start = np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), dtype=np.int64)])
        stack, links_a, links_b = [(depth, start)], [], []
        while stack:
            d, pairs = stack.pop()
            if pairs.shape[1] > frontier:
                half = pairs.shape[1] // 2
                stack += [(d, pairs[:, :half]), (d, pairs[:, half:])]
                continue
            # pairs of single values need no descent
            leaf = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
            if leaf.any():
                a, b = pairs[0, leaf], pairs[2, leaf]
                near = np.bitwise_count(values[a] ^ values[b]) <= allowed
                links_a.append(a[near])
                links_b.append(b[near])
                pairs = pairs[:, ~leaf]
            if not pairs.shape[1] or d >= BITS:
                continue
            if d not in ones:
                ones[d] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1))]).astype(np.int64)
            c = ones[d]
            al, ah, bl, bh, dist = pairs
            am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
            own = al == bl  # a node with itself: both orders of its children are one pair
            nxt = np.concatenate(
                [
                    np.stack([al, am, bl, bm, dist]),
                    np.stack([am, ah, bm, bh, dist]),
                    np.stack([al, am, bm, bh, dist + 1]),
                    np.stack([am, ah, bl, bm, dist + 1])[:, ~own],
                ],
                axis=1,
            )
            live = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= allowed) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
            nxt = nxt[:, live]
            linked = (same[nxt[1] - 1] == same[nxt[0]]) & (same[nxt[3] - 1] == same[nxt[2]]) & (label[nxt[0]] == label[nxt[2]])
            stack.append((d + 1, nxt[:, ~linked]))
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (links_a, links_b))
        if len(a):
            label = _settle(label, a, b)
    return label


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    """Bits from ``by`` on come first."""
    return values if by == 0 else (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def _brought_forward(values: np.ndarray, width: int, sub: int, size: int) -> np.ndarray:
    """Of the bits after the first ``width``, the ``sub``-th ``size`` come first."""
    rest = BITS - width
    after = rest - size * (sub + 1)
    low = values & np.uint64((1 << rest) - 1)
    chosen = (low >> np.uint64(after)) & np.uint64((1 << size) - 1)
    before = low >> np.uint64(after + size)
    return (values ^ low) | chosen << np.uint64(rest - size) | before << np.uint64(after) | low & np.uint64((1 << after) - 1)


def near_links(distinct: DataFrame, budget: int = BUDGET, block: int = 4096) -> DataFrame:
    """Links (a, b) that span every group of fingerprints within ``budget`` bits; ``distinct`` has one row for each ``fp``.

    Values that share a slice meet in one task. Where more than ``block`` do, the same argument holds for their other bits: these
    are sliced again, and values that share a second slice as well meet, so that a value goes to ``(budget + 1) ** 2`` tasks at most
    while fingerprints are spread at all evenly. Only where more than ``block`` agree in both slices, they are dealt into blocks by hash and
    each pair of blocks meets. No task gets more than about twice ``block`` of a group, and no pair is lost.
    """
    slices = budget + 1
    width = BITS // slices
    size = (BITS - width) // slices
    bits = lambda value, at, n: F.shiftrightunsigned(F.shiftleft(value, at), BITS - n)
    heads = [bits(F.col("fp"), width * k, width) for k in range(slices)]
    keyed = distinct.select("fp", F.posexplode(F.array(*heads)).alias("slice", "head"))
    sizes = keyed.groupBy("slice", "head").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["slice", "head"])
    names = ["fp", "slice", "head", "sub", "tail", "x", "y"]
    small = keyed.filter(F.col("n") <= block).select("fp", "slice", "head", *(F.lit(v).cast("long").alias(c) for c, v in (("sub", -1), ("tail", 0), ("x", 0), ("y", 0))))
    turned = F.when(F.col("slice") == 0, F.col("fp"))
    for k in range(1, slices):
        turned = turned.when(F.col("slice") == k, F.shiftleft("fp", width * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - width * k)))
    crowded = keyed.filter(F.col("n") > block).select("fp", "slice", "head", turned.alias("turned"))
    crowded = crowded.select("fp", "slice", "head", F.posexplode(F.array(*(bits(F.col("turned"), width + size * j, size) for j in range(slices)))).alias("sub", "tail"))
    again = crowded.groupBy("slice", "head", "sub", "tail").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    large = crowded.join(again, ["slice", "head", "sub", "tail"]).withColumn("parts", parts).withColumn("mine", mine)
    large = large.select("fp", "slice", "head", "sub", "tail", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    large = large.select("fp", "slice", "head", "sub", "tail", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    meet = small.unionByName(large).select(*(F.col(c).cast("long") for c in names))
    meet = meet.repartition(*names[1:]).sortWithinPartitions(*names[1:])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def solve(part: np.ndarray) -> pa.RecordBatch:
            key, fp = part[:, 1:], part[:, 0]
            values = fp.view(np.uint64).copy()
            for k in range(1, slices):
                at = key[:, 0] == k
                values[at] = _rotated(values[at], width * k)
            for j in range(slices):
                at = key[:, 2] == j
                values[at] = _brought_forward(values[at], width, j, size)
            order = np.lexsort((values, *key.T[::-1]))
            key, fp, values = key[order], fp[order], values[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            label = trie_links(values, np.append(np.flatnonzero(new), len(fp)), width, budget)
            tied = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[label[tied]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block_rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            held.append(block_rows)
            rows += len(block_rows)
            if rows >= 1 << 17:  # solve the keys that are complete; the last one may go on
                part = np.concatenate(held)
                cut = int(np.flatnonzero((part[:, 1:] == part[-1, 1:]).all(axis=1))[0])
                if cut:
                    yield solve(part[:cut])
                held, rows = [part[cut:]], len(part) - cut
        if rows:
            yield solve(np.concatenate(held))

    return map_rows(meet, join, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row for each input row: the key, ``fp`` and ``component_id``, the smallest key that it reaches over links."""
    prints = materialise(fingerprints(df, key, text, words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    links = materialise(near_links(distinct.select("fp"), budget), "simhash_links")
    label = components(links)  # node, component; only nodes that have links
    nodes = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    nodes = materialise(nodes, "simhash_nodes")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its component, with all their columns."""
    found = near_duplicates(df, key, text, words, budget)
    kept = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__kept")).distinct()
    return df.join(kept, df[key].eqNullSafe(kept["__kept"]), "left_semi")
