"""Benchmark decontamination over a positional inverted index in segments.

Documents are cut into words and indexed where they lie: each task writes segments of bounded size, and a segment is one row
with its terms and, for each, the sorted positions of the term in the whole segment. The postings of all words of all documents are
stored, so one index serves any test items. It is distributed by documents; building it moves nothing between machines.

Test items are handed to the tasks in blocks of bounded size, as flat arrays: words as numbers, windows as stretches of them. In a
segment, windows with a word that the segment lacks are out at once. The others start from the postings of their rarest word there;
the lists of their other words, shifted by each word's offset, are intersected one after the other from the rarest on, for all windows
together, until nothing is left. Positions of neighbouring documents are one apart, so no phrase spans two of them. A proximity search
takes the words in any order within a stretch of given length. Only documents with hits come out of a block.

Defined results: null text has no words; an item without words has no windows; repeated rows are judged each on its own; equal
windows of several items count for all of them; empty tables on either side give no hits; other columns are ignored. One item is
never split between blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, without

WINDOW = 10
SEGMENT_WORDS = 1 << 18
BLOCK_BYTES = 16 << 20
#: Candidate positions and windows that are looked at together.
STRETCH, GROUP = 1 << 18, 1 << 14
#: Bytes to bytes: letters lower-cased, what separates words to a space; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII digits and letters and of any other characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8").translate(_TABLE).split()


def pack(places: np.ndarray) -> bytes:
    """Differences of 32-bit numbers, byte by byte: all lowest bytes first, which compresses well."""
    return np.ascontiguousarray(np.diff(places.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32).astype(np.int64)


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments: segment, keys and n_words of its documents, terms, counts (postings of each term) and positions (packed)."""
    kind = df.schema[key].dataType.simpleString()
    names = ["segment", "keys", "n_words", "terms", "counts", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        codes: list[np.ndarray] = []
        key_type = None
        total = 0
        terms: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([np.append(c, np.int32(-1)) for c in codes])  # a position between documents
            order = np.argsort(flat, kind="stable")[len(codes) :]  # without the marks
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().int >> 65]),
                    pa.array([keys], pa.list_(key_type)),
                    pa.array([[len(c) for c in codes]], pa.list_(pa.int64())),
                    pa.array([list(terms)], pa.list_(pa.binary())),
                    pa.array([np.bincount(flat[order], minlength=len(terms))], pa.list_(pa.int64())),
                    pa.array([pack(order)], pa.binary()),
                ],
                names=names,
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words_of(t.as_py())
                keys.append(k)
                codes.append(np.array([terms.setdefault(w, len(terms)) for w in found], dtype=np.int32))
                total += len(found) + 1
                if total >= segment_words:
                    yield flush()
                    keys, codes, total, terms = [], [], 0, {}
        if keys:
            yield flush()

    schema = f"segment long, keys array<{kind}>, n_words array<long>, terms array<binary>, counts array<long>, positions binary"
    return map_rows(df.select(key, text), run, schema)


@dataclass
class Plan:
    """Test items as arrays: ``tokens`` are numbers of ``vocabulary``; window i is ``lengths[i]`` of them from ``starts[i]`` on."""

    vocabulary: pa.Array
    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: list[str]


def plan_of(items: list[tuple], size: int = WINDOW) -> Plan:
    """All windows of ``size`` words; an item of fewer words, but not none, is one window."""
    codes: dict[bytes, int] = {}
    tokens, starts, lengths, owner, names, at = [], [], [], [], [], 0
    for item, text in items:
        if w := words_of(text):
            n = max(1, len(w) - size + 1)
            tokens.append(np.array([codes.setdefault(x, len(codes)) for x in w], dtype=np.int32))
            starts.append(np.arange(at, at + n))
            lengths.append(np.full(n, min(size, len(w)), dtype=np.int32))
            owner.append(np.full(n, len(names), dtype=np.int32))
            names.append(str(item))
            at += len(w)
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return Plan(pa.array(list(codes), pa.binary()), flat(tokens, np.int32), flat(starts, np.int64), flat(lengths, np.int32), flat(owner, np.int32), names)


class Segment:
    """One row of the index, ready for a search."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, packed: bytes):
        self.terms, self.counts, self.places = terms, counts, unpack(packed)
        self.ends = np.cumsum(counts)
        self.keyed = (np.repeat(np.arange(len(counts)), counts) << 32) | self.places  # sorted: by term, then position

    def alive(self, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
        """The plan's words as terms of this segment (-1: not in it), and the windows that have all of theirs."""
        number = pc.fill_null(pc.index_in(plan.vocabulary, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        local = number[plan.tokens] if len(number) else plan.tokens.astype(np.int64)
        there = np.concatenate([[0], np.cumsum(local >= 0)])
        return local, np.flatnonzero(there[plan.starts + plan.lengths] - there[plan.starts] == plan.lengths)

    def phrases(self, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, positions where they start)."""
        local, alive = self.alive(plan)
        for at in range(0, len(alive), GROUP):
            windows = alive[at : at + GROUP]
            lengths = plan.lengths[windows]
            size = int(lengths.max())
            offsets = np.arange(size)
            terms = local[np.minimum(plan.starts[windows, None] + offsets, len(local) - 1)]
            often = np.where(offsets < lengths[:, None], self.counts[terms], np.iinfo(np.int64).max)
            order = np.argsort(often, axis=1, kind="stable")  # rarest first
            rows = np.arange(len(windows))
            first = terms[rows, order[:, 0]]
            stretch = np.cumsum(self.counts[first]) // STRETCH
            for part in np.split(rows, np.flatnonzero(np.diff(stretch)) + 1):
                yield from self._intersect(windows, lengths, terms, order, part, first)

    def _intersect(self, windows, lengths, terms, order, part, first) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = self.counts[first[part]]
        w = np.repeat(part, n)
        within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        start = self.places[np.repeat(self.ends[first[part]] - n, n) + within] - order[w, 0]
        w, start = w[start >= 0], start[start >= 0]
        for k in range(1, order.shape[1]):
            offset = order[w, k]
            want = (terms[w, offset] << 32) | (start + offset)
            found = np.minimum(np.searchsorted(self.keyed, want), len(self.keyed) - 1)
            good = (self.keyed[found] == want) | (k >= lengths[w])
            w, start = w[good], start[good]
            if not len(w):
                return
        if len(w):
            yield windows[w], start

    def near(self, plan: Plan, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, positions of the rarest word around which all their words lie, with up to ``slop`` others between them)."""
        local, alive = self.alive(plan)
        for i in alive.tolist():
            terms = np.unique(local[plan.starts[i] : plan.starts[i] + plan.lengths[i]])
            lists = [self.places[self.ends[t] - self.counts[t] : self.ends[t]] for t in terms[np.argsort(self.counts[terms], kind="stable")]]
            found = near_places(lists, int(plan.lengths[i]) + slop)
            if len(found):
                yield np.full(len(found), i), found


def near_places(lists: list[np.ndarray], reach: int) -> np.ndarray:
    """Positions of the first list around which all lists have one within ``reach`` consecutive positions."""
    anchor = lists[0]
    for x in lists[1:]:  # first what is near at all, rarest words first
        anchor = anchor[np.searchsorted(x, anchor + reach) > np.searchsorted(x, anchor - reach + 1)]
    good = []
    for p in anchor.tolist():
        # with the leftmost word at s, every word has to come within s to s + reach - 1
        for s in sorted({int(q) for x in lists for q in x[np.searchsorted(x, p - reach + 1) : np.searchsorted(x, p, "right")]}):
            if all((i := np.searchsorted(x, s)) < len(x) and x[i] < s + reach for x in lists):
                good.append(p)
                break
    return np.array(good, dtype=np.int64)


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The items, in blocks of about ``limit`` bytes."""
    size = benchmark.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + 16)).first()[0] or 0
    parts = -(-int(size) // limit) or 1
    for i in range(parts):
        yield [(r[0], r[1]) for r in benchmark.filter(F.pmod(F.xxhash64(item, text), F.lit(parts)) == i).select(item, text).collect()]


def _search(index: DataFrame, plan: Plan, slop: int | None) -> DataFrame:
    """(segment, ordinal, hits, items) of the documents with hits: positions of hit words and names of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = batch.column(1)[row].values.to_numpy(zero_copy_only=False)
                counts = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
                if not len(counts):
                    continue
                segment = Segment(batch.column(2)[row].values, counts, batch.column(4)[row].as_buffer().to_pybytes())
                base = np.concatenate([[0], np.cumsum(sizes + 1)])
                hit = np.zeros(int(base[-1]) + 1, dtype=np.int32)
                named: list[np.ndarray] = []
                for windows, starts in segment.phrases(plan) if slop is None else segment.near(plan, slop):
                    np.add.at(hit, starts, 1)
                    np.add.at(hit, starts + (plan.lengths[windows] if slop is None else 1), -1)
                    named.append(np.unique((np.searchsorted(base, starts, "right") - 1 << 32) | plan.items[windows]))
                if not named:
                    continue
                pairs = np.unique(np.concatenate(named))
                found, firsts = np.unique(pairs >> 32, return_index=True)
                items = [plan.names[i] for i in (pairs & 0xFFFFFFFF).tolist()]
                covered = np.flatnonzero(np.cumsum(hit) > 0)
                cuts = np.searchsorted(covered, base)
                n = np.diff(cuts)
                places = (covered - np.repeat(base[:-1], n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(found), pa.int64()),
                        pa.array(found.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(cuts[found], cuts[-1]).astype(np.int32)), pa.array(places)),
                        pa.ListArray.from_arrays(pa.array(np.append(firsts, len(pairs)).astype(np.int32)), pa.array(items, pa.string())),
                    ],
                    names=["segment", "ordinal", "hits", "items"],
                )

    columns = index.select("segment", "n_words", "terms", "counts", "positions")
    return map_rows(columns, run, "segment long, ordinal int, hits array<int>, items array<string>")


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slop: int | None = None,
    block_bytes: int = BLOCK_BYTES,
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """One row for each document: key, n_words, hits (positions of hit words, sorted) and items (sorted as strings).

    With ``slop``, the words of a window may come in any order, with so many other words between them; the hits are then the
    places of the rarest word.
    """
    index = materialise(build_index(df, key, text, segment_words), "postings")
    found = None
    for items in _blocks(benchmark, item, item_text, block_bytes):
        own = _search(index, plan_of(items, window), slop)
        found = own if found is None else found.union(own)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = materialise(found, "hits").groupBy("segment", "ordinal").agg(merged("hits"), merged("items"))
    documents = index.select("segment", F.posexplode(F.arrays_zip("keys", "n_words")).alias("ordinal", "own"))
    documents = documents.select("segment", "ordinal", F.col("own.keys").alias(key), F.col("own.n_words").alias("n_words"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return documents.join(found, ["segment", "ordinal"], "left").select(key, "n_words", empty("hits", "array<int>"), empty("items", "array<string>"))


def clean_documents(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose key has no hit, with all their columns."""
    dirty = find_contamination(df, benchmark, key, text).filter(F.size("hits") > 0).select(F.col(key).alias("id")).distinct()
    return without(df, key, materialise(dirty, "contaminated"))


def windows_of(items: list[tuple], size: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """Each distinct window to the items that have it; for tests."""
    found: dict[tuple[bytes, ...], list] = defaultdict(list)
    for item, text in items:
        w = words_of(text)
        for x in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            found[x].append(item)
    return dict(found)


def brute_force(documents: list[tuple], items: list[tuple], size: int = WINDOW) -> dict:
    """Key to (n_words, n_hit, items), by looking at every window of every document; for tests."""
    windows = windows_of(items, size)
    out = {}
    for k, text in documents:
        w = words_of(text)
        hit, named = set(), set()
        for length in {len(x) for x in windows}:
            for i in range(len(w) - length + 1):
                if (x := tuple(w[i : i + length])) in windows:
                    hit.update(range(i, i + length))
                    named.update(str(j) for j in windows[x])
        out[k] = (len(w), len(hit), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest())
    return out
