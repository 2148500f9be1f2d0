"""BPE codec and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lenticule.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.codec(PATH)


def texts():
    r = random.Random(5)
    words = [w.decode("utf-8", "replace") for w in bpe.codec(PATH).bytes_of]
    yield from ["", " ", "\n", "  a", "a  b \n c\t", "it's we'll 'S <|endoftext|>x", "<|endoftext|>", "é ñ 漢字 😀\x00\x1c\x85\xa0 x", "a" * 5000, " " * 3000 + "x", "1234567890" * 50, "🙂" * 400]
    for n in range(300):
        yield "".join(r.choice(words) for _ in range(r.randint(1, 25)))
        yield "".join(r.choice("aab ht\n.'é") for _ in range(r.randint(1, 80)))


def test_ids_and_round_trip(ours, theirs):
    for t in texts():
        ids = ours.encode(t)
        assert ids.tolist() == theirs.encode(t, add_special_tokens=False).ids, t[:60]
        assert ours.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False) == t


def test_broken_bytes_decode_alike(ours, theirs):
    r = random.Random(6)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randint(1, 12))]
        assert ours.decode(np.array(ids)) == theirs.decode(ids, skip_special_tokens=False)


def test_all_characters_split_alike(ours, theirs):
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(chars), 400):
        t = " a".join(chars[at : at + 400]) + "".join(chars[at : at + 400])
        assert ours.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_memo_bounds_change_nothing(ours):
    small = bpe.PrefixBpe(PATH, memo_entries=3, memo_chars=4)
    for t in list(texts())[:100]:
        assert small.encode(t).tolist() == ours.encode(t).tolist()


def test_frames(spark, theirs):
    df = spark.createDataFrame([(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, None), (3, "", "y")], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(df, decoded="back").collect()
    assert sorted((r["doc_id"], r["ids"], r["back"]) for r in rows) == [(1, theirs.encode("Hello there").ids, "Hello there")] * 2 + [(2, [], ""), (3, [], "")]
    sums = {r["doc_id"]: r for r in bpe.round_trip_digests(df).collect()}
    assert sums[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and sums[1]["n_tokens"] == 2
    assert bpe.encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["first", "most", "share"])
@pytest.mark.parametrize("by", ["line", "paragraph"])
def test_counts_add_up(spark, theirs, by, rule):
    data = [(1, "a b\n\nc  d\n \n\nñé漢\nx"), (2, None), (3, ""), (4, "\n\n\n"), (5, "one line"), (5, "one line"), (6, "q" * 5000 + "\n" + " w" * 5000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("section", F.lit("clash"))
    rows = token_counts.count_by_section(df, by=by, rule=rule).collect()
    for key, t in dict(data).items():
        own = sorted({(r["section"], r["start"], r["end"], r["n_tokens"]) for r in rows if r["doc_id"] == key})
        e = theirs.encode(t or "", add_special_tokens=False)
        assert sum(r[3] for r in own) == pytest.approx(len(e.ids))
        assert own[0][1] == 0 and own[-1][2] == len(t or "") and all(a[2] == b[1] for a, b in zip(own, own[1:]))
        if rule == "first":
            assert [r[3] for r in own] == [sum(s <= a < e_ for a, _ in e.offsets) for _, s, e_, _ in own]


def test_a_crossing_token_goes_by_the_rule():
    starts, lengths = np.array([0, 3, 5]), np.array([2, 5, 1])
    assert token_counts.attribute(starts, lengths, "first").tolist() == [2, 0, 1]
    assert token_counts.attribute(starts, lengths, "most").tolist() == [1, 1, 1] or token_counts.attribute(starts, lengths, "most").tolist() == [1, 1, 1.0]
    assert token_counts.attribute(starts, lengths, "share").tolist() == pytest.approx([1.2, 0.4, 1.4])
