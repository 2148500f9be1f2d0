"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The tokens' spans come from the lengths of their bytes, and an interval join with the
sections' spans, both in order, attributes every token. A token that crosses a boundary goes by one rule:

* ``first``: to the section that holds its first character;
* ``most``: to the section that holds most of its bytes, the earlier one on a tie;
* ``share``: to each section by its share of the token's bytes, so counts may be fractions.

By every rule the counts of a document's sections add up to its token count. Sections tile the text: lines, each with its line
break, or paragraphs, each with the blank lines after it.

Defined results: a null or empty text is one empty section without tokens; repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import codec
from .common import map_rows

SECTIONS = {"line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n(?:[ \t\r]*\n)+")}


def section_starts(raw: bytes, by: str) -> np.ndarray:
    """Byte at which each section starts."""
    ends = [m.end() for m in SECTIONS[by].finditer(raw)]
    if ends and ends[-1] == len(raw):
        ends.pop()
    return np.array([0, *ends], dtype=np.int64)


def attribute(starts: np.ndarray, lengths: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, from the sections' starts and the tokens' lengths in bytes, which tile the same text."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.searchsorted(starts, begins, "right") - 1
    if rule == "first":
        return np.bincount(first, minlength=len(starts)).astype(float)
    last = np.searchsorted(starts, ends, "left") - 1
    inside = first == last
    counts = np.bincount(first[inside], minlength=len(starts)).astype(float)
    for i in np.flatnonzero(~inside).tolist():  # tokens over a boundary
        cuts = [begins[i], *starts[first[i] + 1 : last[i] + 1], ends[i]]
        parts = np.diff(cuts)
        if rule == "share":
            counts[first[i] : last[i] + 1] += parts / lengths[i]
        else:
            counts[first[i] + int(parts.argmax())] += 1
    return counts


def count_by_section(df: DataFrame, key: str = "doc_id", text: str = "text", by: str = "line", rule: str = "first", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row for each section: key, section (from 0), start and end (code points, end exclusive), n_tokens."""
    if by not in SECTIONS or rule not in ("first", "most", "share"):
        raise ValueError(f"no sections by {by!r} or no rule {rule!r}")
    kind = df.schema[key].dataType.simpleString()
    whole = rule != "share"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)

        def pack(owner: list[int], parts: list[tuple], keys: pa.Array) -> pa.RecordBatch:
            number, begin, end, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.repeat(owner, [len(p[0]) for p in parts]))),
                    pa.array(number.astype(np.int32)),
                    pa.array(begin.astype(np.int32)),
                    pa.array(end.astype(np.int32)),
                    pa.array(count.astype(np.int64) if whole else count),
                ],
                names=[key, "section", "start", "end", "n_tokens"],
            )

        for batch in batches:
            owner, parts, held = [], [], 0
            for row, value in enumerate(batch.column(1)):
                content = value.as_py() or ""
                raw = content.encode("utf-8")
                starts = section_starts(raw, by)
                counts = attribute(starts, bpe.lengths[bpe.encode(content)], rule)
                begin = starts
                if len(raw) != len(content):  # bytes to code points
                    lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    begin = np.where(starts > 0, lead[np.maximum(starts - 1, 0)], 0)
                owner.append(row)
                parts.append((np.arange(len(starts)), begin, np.append(begin[1:], len(content)), counts))
                held += len(starts)
                if held > 200_000:
                    yield pack(owner, parts, batch.column(0))
                    owner, parts, held = [], [], 0
            if parts:
                yield pack(owner, parts, batch.column(0))

    return map_rows(df.select(key, text), run, f"`{key}` {kind}, section int, start int, end int, n_tokens {'long' if whole else 'double'}", holds=vocabulary)
