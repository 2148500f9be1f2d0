"""BPE encoding and decoding by dynamic programming over prefixes.

For a byte string, the BPE encoding of every prefix ends in one definite token. An automaton
over the whole vocabulary reports each token that is a suffix of a prefix; the one that fits is
the token ``t`` for which the last token of the remaining shorter prefix and ``t`` form a
compatible pair, which means that BPE, run on the joined bytes of the two, leaves just that pair.
One token per prefix is stored, and back-pointers from the end give the exact ids in linear time.

Compatibility is decided without running merges: both tokens are unwound along the spines that
face the joint, and at each state the merge across the joint must not come before the merge that
ended the state.

Pre-tokenised pieces recur, so their ids are memoised in a table of bounded size.

Defined results: null text encodes as the empty text (no ids); a special token's literal string
in a text is that special token, as the tokenizers library has it by default; repeated rows give
repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, map_rows

# Unicode White_Space, spelled out because libraries differ on the control characters 1C to 1F.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable Latin-1, else from U+0100 on."""
    chars, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            chars.append(chr(b))
        else:
            chars.append(chr(spare))
            spare += 1
    return chars


class _Memo(dict):
    """Piece to packed ids in two generations of bounded size: what is not asked for again goes."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = self.make(piece)
            if len(piece) > self.longest:
                return packed
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


_STOPS = frozenset(".,;:!?")


class _Words(_Memo):
    """The same for words of letters with a space before them; anything else is cut into pieces by ``cut``, each time."""

    def __init__(self, make: Callable[[str], bytes], cut: Callable[[str], bytes], most: int, longest: int):
        super().__init__(make, most, longest)
        self.cut = cut
        self.stop = {c: cut(c) for c in _STOPS}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            return super().__missing__(word)
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return self[word[:-1]] + self.stop[word[-1]]
        return self.cut(" " + word)


class _Fits(dict):
    """Pair of tokens, as one integer, to whether they are compatible; bounded like the memo."""

    def __init__(self, bpe: PrefixBpe, most: int = 150_000):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, pair: int) -> bool:
        a, b = pair >> 20, pair & 0xFFFFF
        known = a == self.bpe.empty or self.bpe.compatible(a, b)
        if len(self) >= self.most:
            self.clear()
        self[pair] = known
        return known


class PrefixBpe:
    """Exact byte-level BPE for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, memo_entries: int = 40_000, memo_chars: int = 48):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in text)
        for text, i in special.items():
            self.bytes_of[i] = text.encode("utf-8")
        self.special = special
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        none = 1 << 40
        self.rank = [-1] * size
        self.left = [-1] * size
        self.right = [-1] * size
        self.joined: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.joined[vocab[a], vocab[b]] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, vocab[a], vocab[b]
        self.none = none
        self.empty = size
        self.size_of = self.lengths.tolist()
        self.fits = _Fits(self)
        self.automaton = ahocorasick.Automaton()
        whole = [False] * size
        for i in sorted(vocab.values(), key=lambda i: self.rank[i]):
            a, b = self.left[i], self.right[i]
            whole[i] = a < 0 or (whole[a] and whole[b] and self._first_cross(a, b) == self.rank[i])
            if whole[i] and self.bytes_of[i]:
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.splitter = regex.compile(PIECES)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.odd = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.memo = _Memo(lambda p: self.encode_bytes(p.encode("utf-8")), memo_entries, memo_chars)
        self.word = _Words(lambda w: self.encode_bytes(b" " + w.encode("utf-8")), self._pieces, memo_entries, memo_chars)
        self.line_break = self._pieces("\n")

    def _first_cross(self, a: int, b: int) -> int:
        """Rank of the merge that would first cross the joint of ``a`` and ``b`` while both form; ``none`` if they meet whole
        and cannot merge. Ranks tie where one pair overlaps itself: the merge further left goes first."""
        rank, none = self.rank, self.none
        found, x, y, until, inner = none, a, b, none, False
        while True:
            r = self.joined.get((x, y), none)
            if r < until or (r == until and inner and r != none):
                found = r
            if rank[x] < 0 and rank[y] < 0:
                return found
            # the later merge is undone first; on equal ranks the one on the right was made last
            if rank[x] > rank[y]:
                until, inner, x = rank[x], False, self.right[x]
            else:
                until, inner, y = rank[y], True, self.left[y]

    def compatible(self, a: int, b: int) -> bool:
        return self._first_cross(a, b) == self.none

    def encode_bytes(self, raw: bytes) -> bytes:
        """Ids of one piece, packed as little-endian unsigned 32-bit integers.

        ``last[i]`` is the last token of the prefix that ends at byte ``i``; the extra slot at the end, which index -1
        reaches, stands for the empty prefix, with which every token is compatible.
        """
        n = len(raw)
        last = [-1] * n
        last.append(self.empty)
        fits = self.fits
        for end, (token, length) in self.automaton.iter(raw.decode("latin-1")):
            if last[end] < 0 and fits[last[end - length] << 20 | token]:
                last[end] = token
        ids, at, lengths = [], n - 1, self.size_of
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return array("I", ids).tobytes()

    def _pieces(self, text: str) -> bytes:
        memo = self.memo
        return b"".join([memo[p] for p in self.splitter.findall(text)])

    def _ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A space before a character that is not white space starts a piece, and a lone line break is a piece. So where white
        space is only lone spaces and line breaks, whole words (with the space before) can be looked up without the pattern.
        """
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(pair in text for pair in ("  ", " \n", "\n ", "\n\n")) or self.odd.search(text):
            return self._pieces(text)
        first, word, out = self._pieces, self.word.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first(words[0]))
            out.extend(map(word, words[1:]))
            out.append(self.line_break)
        out.pop()
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        text = text or ""
        if self.specials is None or not any(s in text for s in self.special):
            packed = self._ordinary(text)
        else:
            parts, at = [], 0
            for m in self.specials.finditer(text):
                parts += [self._ordinary(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
                at = m.end()
            packed = b"".join([*parts, self._ordinary(text[at:])])
        return np.frombuffer(packed, dtype="<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(vocabulary: str) -> PrefixBpe:
    """One codec per worker process and vocabulary, until a task comes that does not hold it."""
    return held(vocabulary, lambda: PrefixBpe(resolve(vocabulary)))


def resolve(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers, on the machine that asks."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _passed(schema, drop: set[str]) -> list[str]:
    return [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema if f.name not in drop]


def encode_documents(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int) and, if named, the text decoded again from them. A column of such a name is replaced."""
    added = {ids, *([decoded] if decoded else [])}
    kept = [f.name for f in df.schema if f.name not in added]
    schema = ", ".join([*_passed(df.schema, added), f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            # few rows at a time: ids of long texts take four bytes each
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [bpe.encode(t) for t in texts.slice(start, 256).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                flat = np.concatenate(out).astype(np.int32) if out else np.empty(0, np.int32)
                cols = [part.column(part.schema.get_field_index(k)) for k in kept]
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *([ids, decoded] if decoded else [ids])])

    return map_rows(df, run, schema, holds=vocabulary)


def round_trip_digests(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Encode and decode each text and return digests of both results instead of the results themselves.

    Columns: the key, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for value in batch.column(1):
                rows = bpe.encode(value.as_py())
                counts.append(len(rows))
                id_sums.append(hashlib.sha256(rows.tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode(rows).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(df.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", holds=vocabulary)
