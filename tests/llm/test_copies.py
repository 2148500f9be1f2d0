"""Exact copies, near copies, components, benchmark passages."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lenticule.llm import decontaminate, exact_dedup, graph, simhash


def test_exact_copies(spark):
    rows = [(1, "Abc"), (5, "aBC"), (3, "abc"), (2, "É"), (4, "é"), (6, None), (7, ""), (8, "x"), (8, "x"), (None, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("digest", F.lit(1))
    got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect())
    assert got == [(-1, 5, 4, False), (1, 5, 4, False), (2, 2, 1, True), (3, 5, 4, False), (4, 4, 1, True), (5, 5, 4, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 2, False), (8, 8, 2, True)]
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 7, 8]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0
    for names in ({"__file": 1, "__row": 2}, {"_metadata": 3}, {"place": 4, "c0": 5, "file": 6, "row": 7}):
        clash = df.withColumns({k: F.lit(v) for k, v in names.items()})
        left = exact_dedup.drop_exact_duplicates(clash)
        assert left.columns == clash.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 7, 8]
        assert {tuple(r) for r in left.select(*names).distinct().collect()} == {tuple(names.values())}


def test_second_delivery_meets_the_first(spark, tmp_path):
    state = str(tmp_path / "state")
    long = "Long " * 500_000
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, long)], "doc_id long, text string")
    first.write.parquet(str(tmp_path / "first"))
    rows = lambda df, name: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df, state=state, delivery=name).collect())
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True)]
    assert rows(spark.read.parquet(str(tmp_path / "first")), "one") == want
    assert rows(spark.read.parquet(str(tmp_path / "first")), "one") == want  # the same name again counts nothing twice
    second = spark.createDataFrame([(0, "B"), (9, "a"), (8, "c"), (3, long.upper())], "doc_id long, text string")
    assert rows(second, "two") == [(0, 3, 2, False), (3, 4, 2, False), (8, 8, 1, True), (9, 9, 3, True)]
    third = spark.createDataFrame([(7, "C")], "doc_id long, text string")
    assert rows(third, "three") == [(7, 8, 2, False)]


def test_salted_groups_are_whole(spark):
    rows = [(i, "Same" if i % 3 else f"own {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in exact_dedup.exact_duplicates(df, split=7).collect():
        assert (r["keep_id"], r["group_size"]) == ((59, 40) if r["doc_id"] % 3 else (r["doc_id"], 1))


def test_equal_digests_of_different_texts(spark):
    texts = [f"text {i % 7}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    for r in exact_dedup.exact_duplicates(df, digest=weak).collect():
        own = [i for i, t in enumerate(texts) if t == texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [None, "", " \t\n", "a", "A b", "a b c", "Über B C d\x0be", "x y z " * 40, "the cat sat on the mat the cat sat"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_trie_join_is_exact():
    rng = np.random.default_rng(2)
    for trial in range(25):
        seeds = rng.integers(0, 2**48, 4, dtype=np.uint64)
        values, roots = [], [0]
        for root in range(3):
            m = int(rng.integers(1, 50))
            x = seeds[rng.integers(0, 4, m)]
            for _ in range(int(rng.integers(0, 6))):
                x = x ^ np.where(rng.random(m) < 0.5, np.uint64(1) << rng.integers(0, 48, m).astype(np.uint64), np.uint64(0))
            x = np.unique(x) | (np.uint64(root) << np.uint64(48))
            values.append(x)
            roots.append(roots[-1] + len(x))
        v, roots = np.concatenate(values), np.array(roots)
        label = simhash.trie_links(v, roots, 16, frontier=int(rng.integers(4, 3000)))
        for a, b in zip(roots, roots[1:]):
            near = np.bitwise_count(v[a:b, None] ^ v[None, a:b]) <= 3
            reach = np.linalg.matrix_power(near.astype(float), b - a) > 0
            assert (label[a:b] == a + reach.argmax(axis=1)).all(), trial


@pytest.mark.parametrize("block", [4096, 8])
def test_links_across_blocks(spark, block):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    values = sorted({base ^ sum(1 << int(b) for b in rng.integers(20, 44, k)) for k in rng.integers(0, 7, 60)} | {int(x) for x in rng.integers(-(2**62), 2**62, 30)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.near_links(df, block=block)
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    u = np.array(values, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    reach = np.linalg.matrix_power(near.astype(float), 64) > 0
    for i, v in enumerate(values):
        assert got.get(v, v) == min(values[j] for j in np.flatnonzero(reach[i]))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 151)}, 199: 199, 200: 199}


def test_near_copies_frame(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(9, long), (4, long + " "), (7, long.upper()), (2, None), (3, ""), (5, "alone here"), (5, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(2, 2), (3, 2), (4, 4), (5, 5), (5, 5), (7, 4), (9, 4)]
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {2, 4, 5}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def passages():
    r = random.Random(8)
    word = lambda: r.choice("abcdefg") * r.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(r.choice([3, 9, 10, 11, 30])))) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (12, "Zz yy XX")]
    docs = []
    for i in range(60):
        t = " ".join(word() for _ in range(r.randint(0, 120)))
        if i % 3 == 0:
            t = t[: len(t) // 2] + " -- " + items[i % 12][1].upper() + "! " + t
        docs.append((i, t))
    return docs + [(70, None), (71, ""), (72, "zz, yy; xx zz yy"), (73, "é zz yy xxé")], items


@pytest.mark.parametrize(("words", "block"), [(1 << 20, 1 << 24), (150, 200)])
def test_passages_match_brute_force(spark, words, block):
    docs, items = passages()
    docs = [(k, t) for k, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("hits", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute_force(docs, items)
    found = decontaminate.find_contamination(df, bench, segment_words=words, block_bytes=block).collect()
    import hashlib

    assert len(found) == len(docs)
    for r in found:
        assert (r["n_words"], len(r["hits"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) == want[r["doc_id"]]
    left = decontaminate.clean_documents(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {k for k, v in want.items() if not v[1]}


def test_no_benchmark_or_no_documents(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_contamination(df, none).collect()] == [(1, 3, [], [])]
    assert decontaminate.find_contamination(df.limit(0), df.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "one two x three four"), (2, "four three two one"), (3, "one two y y y y three four"), (4, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.find_contamination(df, bench, slop=2).collect() if r["hits"]}
    assert got == {1, 2}


def plain_groups(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    group = {k: k for k in texts}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_pipeline_stage_drops_all_near_copies(spark):
    import corpus_pipeline

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    texts = {1: None, 2: " ", 3: "Two words", 4: "two WORDS", 5: line}
    for base in range(40):
        own = [word() for _ in range(r.choice([12, 60, 300]))] + line.split()
        for copy in range(5):
            edited = list(own)
            for _ in range(r.randrange(1 + len(own) // 30)):
                edited[r.randrange(len(own))] = word()
            texts[100 + 10 * base + copy] = " ".join(edited)
    want = plain_groups(texts)
    assert 60 < sum(k != g for k, g in want.items()) < 160
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n", F.lit("clash"))
    left = corpus_pipeline.drop_near_copies(spark, df, None)
    assert left.columns == df.columns and sorted(x["doc_id"] for x in left.collect()) == sorted(k for k, g in want.items() if k == g)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), None).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A b c"), (5, words), (6, words + " x"), (7, "so it says: one two three four"), (None, "no key"), (8, "😀 " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("mine"), "_metadata": F.lit(1), "node": F.lit(2), "place": F.lit(3), "score": F.lit(4), "hits": F.lit(5)})
    spark.createDataFrame([(1, "One two, three FOUR"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "some/benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "some/labels.parquet"))
    df.write.parquet(str(tmp_path / "some/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert out.columns == [*df.columns, "ids_"]
    got = out.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "no key"), (2, ""), (4, "A b c"), (5, words), (8, rows[-1][1])]
    assert all(r["ids"] == "mine" and r["hits"] == 5 and (len(r["ids_"]) > 0) == bool(r["text"]) for r in got)
    for name in ("benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"some/{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"none/{name}.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_memory_is_given_back(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from lenticule.llm import exact_dedup

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.createDataFrame([(i, f"word{i % 3} a b c d e f") for i in range(9)], "doc_id long, text string")
    before = collections()
    assert corpus_pipeline.drop_exact_copies(spark, docs, "").count() == 3
    assert collections() > before
    # the state of a local folder is kept without a process for each of its files
    made, new = [], type(spark).newSession
    monkeypatch.setattr(type(spark), "newSession", lambda self: made.append(new(self)) or made[-1])
    assert exact_dedup.exact_duplicates(docs, state=f"file://{tmp_path}/state").filter("kept").count() == 3
    for name, value in exact_dedup.LOCAL_STORE.items():
        assert made[0].conf.get(name) == value
