"""Toxicity, quality, URL filter, personal data, archives and the pipeline."""

import base64
import hashlib
import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lenticule.llm import pii, quality, registry, toxicity, url_filter, warc


def corpus():
    r = random.Random(1)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    rows = []
    for i in range(400):
        toxic = i % 5 == 0
        lines = [" ".join(word() for _ in range(8)).capitalize() + "." for _ in range(4)]
        if toxic:
            lines[r.randrange(4)] = f"you {r.choice(['zork', 'zorkish', 'blarg'])} {word()}!"
        bad = i % 7 == 0
        if bad:
            lines = [" ".join(w + "###" for w in line.upper().split()) for line in lines]
        rows.append((i, "\n".join(lines), int(toxic), int(not bad)))
    return rows


def test_toxic_sentences_are_learnt_and_found(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t) for k, t, _, _ in rows] + [(900, None), (901, ""), (902, "you zork " * 20_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, x) for k, _, x, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(df, labels, "toxic", F.col("doc_id") % 4 != 2, "doc_id", "text", 250, 20_000)
    assert len(texts) == 250
    model = toxicity.train(texts, y)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    held = [(k, x) for k, _, x, _ in rows if k % 4 == 2]
    assert sum((got[k]["score"] >= 0.3) == bool(x) for k, x in held) / len(held) > 0.97
    span = next(got[k]["offending"][0] for k, x in held if x and got[k]["offending"])
    assert span["end"] > span["start"]
    assert got[900]["score"] == got[901]["score"] < 0.3 <= got[902]["score"]
    kept = toxicity.keep_below(df, model, 0.3)
    assert kept.columns == df.columns and kept.count() == sum(r["score"] < 0.3 for r in got.values())
    none = toxicity.train([b"a"], y[:1])
    assert {r["score"] for r in toxicity.score_documents(df, none).collect()} == {0.0}


def test_bad_lines_are_learnt(spark):
    rows = corpus()
    model = quality.train([t.encode() for k, t, _, _ in rows if k % 5], __import__("numpy").array([g for k, _, _, g in rows if k % 5]))
    df = spark.createDataFrame([(k, t) for k, t, _, _ in rows if not k % 5] + [(900, None), (901, " \n "), (902, "fine words here.\n" * 5000)], "doc_id long, text string").withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in quality.score_documents(df, model).collect()}
    assert all((got[k]["score"] >= 0.3) == bool(g) for k, _, _, g in rows if not k % 5)
    assert got[900]["score"] == got[901]["score"] and 0 <= got[902]["score"] <= 1


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=3 * quality.FEATURES), rng.normal(size=(2, 2)))
    lines = [b"Some words here.", b"### LOUD!!", b"more text", b"1 2 3", b"end."]
    unary = quality.chain_features(lines) @ model.weights
    total = np.zeros(2 * len(lines)).reshape(len(lines), 2)
    for labels in itertools.product((0, 1), repeat=len(lines)):
        p = np.exp(sum(unary[i] for i, y in enumerate(labels) if y) + sum(model.pairs[a, b] for a, b in zip(labels, labels[1:])))
        for i, y in enumerate(labels):
            total[i, y] += p
    assert model.marginals(lines) == pytest.approx((total[:, 1] / total.sum(axis=1)).tolist())


def test_rules_and_models_of_urls(spark):
    r = random.Random(3)
    rows = [(i, f"https://{r.choice(['good', 'kind'])}{r.randrange(99)}.net/de/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://{r.choice(['spam', 'bets'])}{r.randrange(99)}.com/en/{i}?q") for i in range(300)]
    rows += [(2000, None), (2001, "no scheme"), (2002, "HTTP://A.Example.COM/en/7x#y"), (2003, "x://example.net/de/81"), (2004, "x://notcom/en/"), (2005, "x://good1.net/xx"), (2006, "x://spam1.com/yy"), (2007, "a://b?c://d/e"), (2005, "x://good1.net/xx"), (2008, "x://" + "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "text": F.lit(2)})
    out = url_filter.judge(df).collect()
    got = {x["page_id"]: x for x in out}
    assert len(out) == len(rows)
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in (2000, 2001, 2002, 2003, 2004, 2007)] == [("", "", None), ("", "", None), ("a.example.com", "/en/7x", "example.com/en/7"), ("example.net", "/de/81", "example.net/de/8"), ("notcom", "/en/", None), ("b", "", None)]
    assert (got[2002]["verdict"], got[2003]["verdict"], got[2005]["verdict"], got[2006]["verdict"]) == ("allow", "block", "allow", "block")
    assert {x["verdict"] for x in url_filter.judge(df.filter("page_id >= 2004")).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0
    for name in ("host", "path", "rule", "text", "rule_verdict"):
        named = url_filter.judge(df.drop("host", "text").withColumnRenamed("page_id", name), key=name)
        assert named.columns[0] == name and named.count() == len(rows)
    tails = spark.createDataFrame([*rows[:600], (1, "http://x.io/p?aaaa"), (2, "http://x.io/p?zzzz#q")], "page_id long, url string")
    assert len({x["score"] for x in url_filter.judge(tails).filter("path = '/p'").collect()}) == 2


def test_long_urls_are_counted_whole():
    r = random.Random(9)
    texts = ["".join(r.choice("abc") for _ in range(n)).encode() for n in (0, 3, url_filter.STRETCH - 1, url_filter.STRETCH, 2 * url_filter.STRETCH + 7, 5)]
    got = {i: [] for i in range(len(texts))}
    for owners, pieces in url_filter._stretches(texts, 5):
        for g, o in zip(*url_filter._grams(owners, pieces, 5), strict=True):
            got[int(o)].append(int(g))
    for i, t in enumerate(texts):
        marked = b"\0" * 5 + t + b"\1"
        assert got[i] == [int.from_bytes(marked[p - 5 : p + 1]) for p in range(5, len(marked))]


def test_rules_on_pages(spark):
    """Host, path and rule of all given pages, by plain code."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rules = sorted([("com", "/en/"), ("example.com", "/en/7"), ("net", "/de/"), ("example.net", "/de/8"), ("org", "/es/")], key=lambda x: -len(x[0] + x[1]))
    for x in registry.op2_url_filter(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url"), "page_id").collect():
        rest = x["url"].partition("://")[2] if x["url"] else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [h + p for h, p in rules if (low(host) == h or low(host).endswith("." + h)) and path.startswith(p)]
        assert (x["host"], x["path"], x["rule"]) == (low(host), path, fits[0] if fits else None)


def test_url_scores_are_those_of_exact_counts(spark):
    import math
    from collections import Counter

    r = random.Random(6)
    path = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400))
    rows = [(i, f"x://{('a.net/de/', 'a.com/en/', 'a.io/')[i % 3]}{path()}") for i in range(600)] + [(600, "x://a.io/"), (601, "x://a.net/de/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    trained = {x["url"] for x in df.filter("pmod(xxhash64(url), 5) <> 0").collect()}
    full, bare = ({"net": Counter(), "com": Counter()} for _ in range(2))

    def grams(url):
        t = "\0" * 5 + url + "\1"
        return [[t[i - k : i + 1] for k in range(6)] for i in range(5, len(t))]

    for _, url in rows:
        kind = url[6:9]
        if url in trained and kind in full:
            for g in grams(url):
                full[kind].update(g)
                bare[kind].update((len(x), x[:-1]) for x in g)
    assert sum(map(len, full.values())) > 1 << 18
    got = {x["page_id"]: x["score"] for x in url_filter.judge(df).collect()}
    for i, url in rows[-62:]:
        total = 0.0
        for g in grams(url):
            p = {kind: 1 / 257 for kind in full}
            for x in g:
                p = {kind: (full[kind][x] + 1.5 * p[kind]) / (bare[kind][len(x), x[:-1]] + 1.5) for kind in p}
            total += math.log(p["net"]) - math.log(p["com"])
        assert got[i] == pytest.approx(total / len(grams(url)), abs=1e-6)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def iban_ok(m):
    bare = m.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])", iban_ok),
    "local_phone": (r"(?<![0-9+])0[0-9]++(?:[\x20/.-]?+[0-9]++){1,6}+(?![0-9])", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    "secret": (r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+", lambda m: bool(re.search("[0-9]", m) and re.search("[A-Za-z]", m)) and len(set(m)) >= 10),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000"),
    "national_id": (r"(?<![A-Za-z0-9])[0-9]{8}[A-Z](?![A-Za-z0-9])", lambda m: "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[:8]) % 23] == m[8]),
}


def all_plain_spans(text):
    """Every kind with its score, straight from the text."""
    import regex

    c, text = pii.PiiConfig(), text or ""
    base = plain_spans(text)

    def score(kind, s, e):
        own = 0.9 if kind == "secret" and re.match("AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|eyJ", text[s:e]) else c.base_score[kind]
        near = re.search(c.context[kind], (text[max(0, s - 40) : s] + " " + text[e : e + 40]).lower())
        return min(1.0, own + (0.3 if near else 0))

    out = [(s, rank, e, kind, score(kind, s, e)) for s, rank, e, kind in base]
    for rank, (kind, (pattern, valid)) in enumerate(ADDED.items(), len(PLAIN)):
        for m in regex.finditer(pattern, text):
            s, e = m.span()
            if valid(m[0]) and score(kind, s, e) >= 0.6 and (kind == "iban" or not any(b[0] < e and s < b[2] for b in base)):
                out.append((s, rank, e, kind, score(kind, s, e)))
    return ",".join(f"{k}:{s}:{e}:{p:.2f}" for s, _, e, k, p in sorted(out))


def test_personal_data(spark):
    r = random.Random(2)
    bits = ["a", ".", "@", "-", "_", "1", "23", "+", "0", "255", "256", " ", "é", "4111111111111111", "(", ")", "1.2.3.4", "a@b.c", "\n", "😀", "x@y", "%"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(800)]
    rows += [(900, None), (901, ""), (902, "9" * 3000), (903, "a" * 3000 + "@"), (904, "1.2.3.4 " * 1500), (905, "1 " * 3000)]
    rows += [(906, "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013001, call 030 1234567; 030 7654321")]
    rows += [(907, "GB08WEST12345698765018"), (908, "call 030 1234567; 030 7654321"), (909, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" ghp_0123456789abcdefABCD'), (910, "SSN 123-45-6789 000-12-3456; DNI 12345678Z 12345678A")]
    words = ["call", "token", "key", "ssn", "dni", "iban", "030 123456", "0301234567", "GB82WEST12345698765432", "12345678Z", "123-45-6789", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "a@b.co", "+49 30 123456789", "é", "some more words", "10.0.0.1", "4111111111111111"]
    rows += [(1000 + i, r.choice([" ", ", ", "; "]).join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string").withColumn("pii", F.lit("clash"))
    found = pii.span_digests(pii.find_personal_data(df)).collect()
    assert len(found) == len(rows) + 1
    for x in found:
        text = dict(rows)[x["doc_id"]]
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in plain_spans(text))
        assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), x["doc_id"]
        every = ",".join(f"{a}:{b}" for a, b in zip(x["spans"].split(","), x["scores"].split(","), strict=True)) if x["spans"] else ""
        assert every == all_plain_spans(text), x["doc_id"]
    kinds = {x["doc_id"]: [s.split(":")[0] for s in x["spans"].split(",")] for x in found if x["doc_id"] in range(906, 911)}
    assert kinds[907] == ["iban", "card"] and kinds[908] == ["local_phone"] * 2 and kinds[909] == ["secret"] * 2 and kinds[910] == ["ssn", "national_id"]
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_archives(spark):
    rows = [(5, "u://a b\n", "same\r\n\r\nWARC/1.1\r\n"), (2, "u", "same\r\n\r\nWARC/1.1\r\n"), (9, None, None), (3, "u", ""), (7, "u", "é" * 5000), (None, "u", "é" * 5000), (8, "u", "é" * 5000), (1, "u", "x"), (1, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "key": F.lit(2)})
    got = sorted(tuple(-1 if v is None else v for v in r) for r in warc.archive_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())

    def want(key, html, kind, to=-1):
        raw = (html or "").encode()
        return (key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, to)

    same, long = rows[0][2], rows[4][2]
    assert got == sorted([want(5, same, "revisit", 2), want(2, same, "response"), want(9, "", "revisit", 3), want(3, "", "response"), want(7, long, "response"), want(-1, long, "response"), want(8, long, "revisit", 7), want(1, "x", "response"), want(1, "x", "response")])
    assert [r["record_type"] for r in warc.archive_round_trip(df.filter("page_id in (9, 3)"), least_bytes=1).collect()] == ["response", "response"]
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_of_long_payloads(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    long = "".join(r.choice("abcdefgh") for _ in range(300_000)) * 60  # 18 MB: the member's length ends in a byte that is not zero
    rows = [(i, f"u://{i}", t) for i, t in enumerate([long, "a" * 100, long, "b", "a" * 100, *(f"own {i} " * 50_000 for i in range(12))])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {(i, next((j for j, _, u in rows[:i] if u == t), None), len(t)) for i, _, t in rows}
    seen = []
    for name, few in (("broadcast", warc.MOST_IDS), ("filtered", 0)):
        monkeypatch.setattr(warc, "MOST_IDS", few)
        path = str(tmp_path / name)
        warc.write_archives(df.repartition(2), path, volume=20_000)
        found = warc.resolved(warc.read_archives(spark, path))
        assert {(x["key"], x["refers_to"], x["payload_bytes"]) for x in found.collect()} == want
        for file in (tmp_path / name).rglob("part-*.txt"):
            kinds = [h["warc-type"] for h, _ in warc.records(file.read_bytes())]
            assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
            heads = [h for h, _ in warc.records(file.read_bytes()) if h["warc-type"] == "revisit"]
            assert all(h["warc-refers-to-target-uri"] == "u://" + h["warc-refers-to"][10:-1] for h in heads)
            seen.append(file.stat().st_size)
    assert len(seen) > 4
    lost = warc.read_archives(spark, path).filter("record_type = 'revisit'")
    with pytest.raises(Exception, match="not there"):
        warc.resolved(lost).collect()


def test_noisy_or_matches_enumeration():
    import itertools
    import math

    model = toxicity.ToxicityModel(bias=-2.0, slope=1.0, shift=0.0, trained=True)
    logits = [-1.0, 0.5, -3.0]
    p = [1 / (1 + math.exp(-z)) for z in [model.bias, *logits]]
    some = sum(math.prod(q if on else 1 - q for q, on in zip(p, case)) for case in itertools.product((0, 1), repeat=len(p)) if any(case))
    assert model.document(logits) == pytest.approx(some)


def test_labels_that_disagree_are_left_out(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (2, "another two"), (3, "three"), (4, "x" * 100), (6, None)], "doc_id long, text string")
    labels = [(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (3, None), (4, 1), (5, 1), (6, 0)]
    for parts in (1, 2, 5):
        marks = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(parts)
        texts, y = toxicity.labelled_sample(df, marks, "toxic", F.lit(True), "doc_id", "text", 10, 50)
        assert (texts, y.tolist()) == ([b"another two", b"three", b""], [1, 0, 0])
    few, _ = toxicity.labelled_sample(df, marks, "toxic", F.lit(True), "doc_id", "text", 2, 50)
    assert len(few) == 2  # keys without a usable text do not use up the limit


def test_training_batches_are_bounded():
    sizes = [1] * 300 + [40] * 30 + [20_000]
    batches = list(quality._like_lengths(sizes, 1000))
    assert sorted(i for b in batches for i in b.tolist()) == list(range(len(sizes)))
    assert all(len(b) == 1 or len(b) * max(sizes[i] for i in b) <= 1000 for b in batches)


def test_models_on_empty_and_repeated_rows(spark):
    rows = corpus()
    texts, tox, good = [t.encode() for _, t, _, _ in rows], *(__import__("numpy").array([x[i] for x in rows]) for i in (2, 3))
    df = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (2, rows[0][1])], "doc_id long, text string")
    for scored in (toxicity.score_documents(df, toxicity.train(texts, tox)), quality.score_documents(df, quality.train(texts, good, quality.QualityConfig(epochs=5)))):
        assert len({x["score"] for x in scored.collect()}) == 1 and scored.count() == 3
    assert toxicity.score_documents(df.limit(0), toxicity.ToxicityModel()).count() == quality.score_documents(df.limit(0), quality.QualityModel()).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name]).project(", ".join(cols)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(repr, want))


def test_pipeline_against_plain_code(spark):
    import itertools

    import corpus_pipeline

    from lenticule.llm import bpe, decontaminate

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    scored = {r["doc_id"]: r["score"] for r in registry.op5_toxicity(spark, DATA).collect()}
    left = {k: t for k, t in docs.items() if scored[k] < registry.TOXIC_FROM}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    best = {}
    for k, t in left.items():
        best[low(t)] = max(k, best.get(low(t), k))
    left = {k: docs[k] for k in best.values()}
    shingles = {}
    for k, t in left.items():
        w = t.encode().lower().split()
        shingles[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    group = {k: k for k in left}
    for a, b in itertools.combinations(sorted(left), 2):
        if group[a] != group[b] and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
            low_, high_ = sorted((group[a], group[b]))
            group = {k: low_ if g == high_ else g for k, g in group.items()}
    left = {k: t for k, t in left.items() if group[k] == k}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hits = decontaminate.brute_force(list(left.items()), items)
    left = {k: t for k, t in left.items() if not hits[k][1]}
    codec = bpe.codec(bpe.resolve(registry.BPE_VOCABULARY))
    assert {k: r["ids"] for k, r in rows.items()} == {k: codec.encode(t).tolist() for k, t in left.items()}
