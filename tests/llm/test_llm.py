"""Training-data operators against SQL, brute force, exact round trips and held-out rows."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from vdjloom.llm import (
    catalog, chosenpath, components, langid, licenses, losertree, mixing, rollup, search, shard, toxicity, warc, winnow,
)
from vdjloom.llm.shared import new_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SQL = [n for n, (_, sql) in catalog.QUERIES.items() if sql]
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _WORDS.findall((text or "").translate(_LOW))


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", SQL)
def test_same_rows_as_sql(spark, sf_dir, con, name):
    names, ours = oracle.run_spark(catalog.QUERIES[name][0](spark, sf_dir))
    assert oracle.difference(names, ours, con, catalog.QUERIES[name][1]) == ""


def test_registered():
    assert {*catalog.QUERIES, "pipeline"} <= set(driver.queries())


ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three", None, "a", 1),
    (4, "one two three", "fr", None, 1), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 1),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 1),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 1),
    (6, "x" * 200_000 + " " + "mot " * 60_000, "fr", "b", 1), (7, "!!! ... ###", "de", "b", 1),
    (8, "Released under the MIT\nLicense. mit  LICENSE cc-by", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and a column whose name clashes."""
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("x"))


# 1: captures

@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted((int(x),) for x in rng.integers(0, 20, rng.integers(0, 30))) for _ in range(k)]
    got = [(runs[r][i], r) for r, i in losertree.merge(runs)]
    assert got == sorted((x, r) for r, run in enumerate(runs) for x in run)


def test_archive_round_trip(spark):
    rows = [(1, "http://www.B.org/x#f", "a\r\n\r\nWARC/1.1\r\n"), (2, "http://a.org/", "é" * 50_000), (3, None, None), (4, "x\r\ny", ""),
            (5, "http://a.org/", "é" * 50_000), (None, "http://a.org/", "é" * 50_000), (None, "u", "alone"), (7, "u", "twin"), (7, "u", "twin")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record", F.lit(1))
    got = warc.capture_history(pages).collect()
    assert sorted(r["capture_no"] for r in got) == list(range(len(rows)))
    order = [(r["url_key"].encode(), r["captured_at"], r["page_id"] is not None, r["page_id"] or 0)
             for r in sorted(got, key=lambda r: r["capture_no"])]
    assert order == sorted(order)
    by = {(r["page_id"], r["payload_bytes"]): r for r in got}
    assert (by[2, 100_000]["record_type"], by[2, 100_000]["refers_to"]) == ("revisit", 5)
    assert (by[None, 100_000]["record_type"], by[None, 5]["record_type"]) == ("revisit", "response")
    assert (by[3, 0]["refers_to"], by[4, 0]["record_type"]) == (4, "response")
    assert [r["record_type"] for r in got if r["page_id"] == 7] == ["response", "response"]
    assert by[1, 15]["url_key"] == "org,b)/x" and by[3, 0]["url_key"] == ""
    folder = new_path(spark, "warc")
    warc.write_archive(pages, folder, least=6)
    assert {r["page_id"]: r["record_type"] for r in warc.read_runs(spark, folder).collect()}[3] == "response"
    kept = {h["WARC-Record-ID"]: p for f in spark.read.format("binaryFile").load(folder).collect() for _, h, _, p in warc.parse(f["content"])}
    assert kept["<urn:x-page:1>"] == b"a\r\n\r\nWARC/1.1\r\n" and kept["<urn:x-page:5>"] == ("é" * 50_000).encode()
    assert warc.capture_history(pages.limit(0)).count() == 0


# 2 and 3: classifiers

def test_toxicity_learns_from_its_rows_only(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/labels.parquet")
    big = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet")
    out = toxicity.toxicity(big, labels).join(labels, "doc_id").toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    held = out[out["held_out"]]
    hit = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hit / (held["predicted"] == 1).sum() > 0.8 and hit / (held["toxic"] == 1).sum() > 0.7
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    sample = docs.limit(50)
    assert toxicity.score(sample, toxicity.fit(big, flipped)).collect() == toxicity.score(sample, toxicity.fit(big, labels)).collect()


def test_pairs_of_terms_matter():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    lists = [np.array([i for i, x in ((5, p), (9, q)) if x] + [100], np.int64) for p, q in zip(a, b, strict=True)]
    m = toxicity.train(lists, a & b)
    at = lambda *t: m.score(np.zeros(len(t), int), np.array(sorted(t)), 1)[0]
    assert at(5, 9, 100) > 0.8 and max(at(5, 100), at(9, 100), at(100)) < 0.2
    assert m.factor[m.slot[5]] @ m.factor[m.slot[9]] > 0.5


def test_a_term_that_matters_only_with_another():
    rng = np.random.default_rng(2)
    group, insult, other = (rng.random(toxicity.SAMPLE) < 0.2 for _ in range(3))
    label = np.where(group, insult, other)  # the group is toxic as often as the rest, but by the insult
    base = label.mean()
    assert abs(label[group].sum() - group.sum() * base) < toxicity.LEAST_Z * math.sqrt(group.sum() * base * (1 - base))
    lists = [np.array([t for t, x in ((5, p), (9, q), (13, r)) if x] + [100], np.int64) for p, q, r in zip(group, insult, other, strict=True)]
    m = toxicity.train(lists, label)
    at = lambda *t: m.score(np.zeros(len(t), int), np.array(sorted(t)), 1)[0]
    assert at(5, 9, 100) > 0.7 and max(at(5, 100), at(9, 100), at(100)) < 0.3


def test_language(spark, sf_dir):
    big = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = langid.identify(big).join(big.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()


def test_windows_cover_every_byte():
    raw = [b"", b"a" * 255, b"b" * 256, b"c" * 700]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    x, row, size = langid.windows(data, offsets)
    assert [b"".join(x[i][:size[i]].tobytes() for i in np.flatnonzero(row == r)) for r in range(4)] == raw


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, None), (None, 1)], "doc_id bigint, toxic int")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).count() == 0
    assert len({r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()}) == 1
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert got[1] == got[2] == got[7] == "und" and got[6] in ("en", "fr", "de")
    assert langid.identify(odd.limit(0)).count() == 0
    assert langid.known(odd).columns == odd.columns


# 4: search

def test_search_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(300)]
    rows += [(i, [0.25] * 12) for i in range(300, 400)] + [(400, [float("nan")] * 12), (420, None), (440, [None] * 12),
             (None, [0.5] * 12), (460, [0.5] * 3), (461, [0.5] * 3), (480, [1e30, 0.5]), (481, [1e-30, 2.0]), (500, [float("inf")] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(0))
    got = defaultdict(list)
    for r in search.top_k(vectors, k=7).collect():
        got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows[:400]}
    for q in range(0, 400, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(best)]
    assert sorted(got) == [*range(0, 400, 20), 460, 480] and [x[2] for x in got[460]] == [461]
    assert search.top_k(vectors.limit(0)).count() == 0


def test_search_prunes(monkeypatch):
    rng = np.random.default_rng(4)
    c = rng.integers(-30, 30, (64, 5000)) * np.linspace(2, 0.1, 64).astype(int)[:, None]
    ids = np.arange(5000)
    for i, best, scores in search.search_block(ids[:40], c[:, :40], ids, ids, c, 20):
        all_scores = c[:, i] @ c
        all_scores[i] = -10 ** 12
        assert list(best) == list(np.lexsort([ids, -all_scores])[:20]) and scores == [int(all_scores[b]) for b in best]


# 5: shards

def test_shards(spark, docs, odd, texts):
    rows = shard.shard(docs).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    out = shard.shard(odd).collect()
    assert len(out) == len(ODD) and min(r["size"] for r in out) == 1 and shard.shard(odd.limit(0)).count() == 0
    assert shard.place(odd.withColumn("shard", F.lit(1))).columns[-1] == "_shard"


def test_tree_moves_only_what_changed(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    before = shard.layout(16)
    count = {r["s"]: r["count"] for r in ids.groupBy(shard.descend(F.col("doc_id").cast("string"), before).alias("s")).count().collect()}
    assert len(count) == 16 and max(abs(n - 2500) for n in count.values()) < 250
    after = {r: {k: dict(s) for k, s in racks.items()} for r, racks in before.items()}
    after["r0"]["k0"][0] = 3.0
    for r in shard.moved(ids, before, after).collect():
        assert r["new_shard"] < 8  # into the region that grew
        if r["shard"] < 8:  # into the rack that grew, and inside it into the shard
            assert r["new_shard"] < 4 and (r["shard"] >= 4 or r["new_shard"] == 0)
    assert {r["new_shard"] for r in shard.moved(ids, shard.layout(20), shard.layout(21)).collect()} == {20}


# 6: mix

def test_mix(spark, odd):
    rows = [(i, "w " * (i % 9 + 1), None, s, 0) for i, s in enumerate(["b", "a", None, "é", "z"] * 200)]
    table = spark.createDataFrame(rows, DOCS)
    out = mixing.summary(table).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    for r, row in zip(sorted(out, key=lambda r: r["doc_id"]), rows, strict=True):
        by[row[3]][0] += r["size"]
        by[row[3]][1] += r["taken"]
        by[row[3]][2] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] % r["size"] == 0
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - 1.5 * total) < 1e-6
    assert all(x[2] <= 2 * x[0] + 1e-9 and abs(x[1] - x[2]) < 0.25 * x[0] for x in by.values())
    open_ = {s: by[s][2] / w for s, w in {"a": 5, "b": 2, "z": 1, "é": 5, None: 2}.items() if by[s][2] < 2 * by[s][0]}
    assert max(open_.values()) - min(open_.values()) < 1e-6
    mixed = mixing.mix(table.withColumn("size", F.lit(1)))
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["taken"] // r["size"] for r in out if r["taken"]})
    assert mixed.columns == [*table.columns, "size"]
    assert sorted(mixing.summary(table).collect()) == sorted(out)
    assert mixing.summary(odd).count() == len(ODD) and mixing.summary(odd.limit(0)).count() == 0


def test_mix_with_many_sources(spark, monkeypatch):
    table = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', 3) AS text", "concat('s', id % 50) AS source")
    few = sorted(mixing.summary(table).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted(mixing.summary(table).collect()) == few


# 7: decontamination

def overlap(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def check_overlap(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hits", F.lit(1))
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, overlap([r["text"] for r in rows], items), strict=True))
    assert Counter(tuple(r) for r in winnow.decontaminate(docs, bench).collect()) == want
    dirty = sum(n for k, n in want.items() if k[-1])
    assert winnow.clean(docs, bench).count() == len(rows) - dirty
    return dirty


def test_decontamination(spark, sf_dir, docs, odd):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert check_overlap(spark, docs, items) > 0
    short = [(1, "the of"), (2, "and the"), (3, None), (4, "..."), (5, items[0][1]), (5, items[0][1]), (6, " ".join(words(items[1][1])[:5])),
             (7, " ".join(words(items[1][1])[:10])), (8, " ".join(words(items[1][1])[3:12])), (9, "a")]
    assert check_overlap(spark, docs, short) > 0
    assert check_overlap(spark, odd, [(1, "ONE two-three"), (2, "mot " * 12), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]) == 6
    assert check_overlap(spark, odd, []) == 0 and winnow.decontaminate(odd.limit(0), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0


# 8: licenses

def test_licenses(spark, odd):
    rows = [
        (1, "x\nReleased under the MIT License.\ny"), (2, "the license released under a roof"), (3, "GNU  general\tpublic-license, gnu general public"),
        (4, "Permission hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in "
            "the software without restriction"), (5, "éCC BY CC BYé cc by"), (6, "Apache License CC BY-NC 4.0 licensed under"), (7, None)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["labels"]) == (1, 4, "mit,notice-mit")
    assert (got[2]["labels"], got[2]["score"]) == ("", 0.0)
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["labels"]) == (1, 0, 0, "gpl")
    assert got[4]["labels"] == "text-mit" and 0.9 <= got[4]["score"] < 1 and got[4]["first_word"] is None
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"]) == (1, 4, 4)
    assert got[6]["labels"] == "apache,cc-by,notice-cc-by-nc-4" and (got[6]["first_word"], got[6]["last_word"]) == (0, 2)
    assert (got[7]["n_words"], got[7]["labels"]) == (0, "")
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(odd.limit(0)).count() == 0


def test_wrapped_licenses(spark):
    rows, want = [], {}
    for name, text in licenses.TEMPLATES.items():
        for k, (width, mark) in enumerate(((72, ""), (30, ""), (72, "# "), (72, "dnl "))):
            notice = "\n".join(mark + x for x in textwrap.wrap(text, width))
            rows.append((len(rows), f"{'before ' * 300}\n{notice} and {'after ' * 300}"))
            want[len(rows) - 1] = name
        rows.append((len(rows), " ".join(w + " apart" * 40 + "\n" for w in text.split())))  # the words, but no notice
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, r in got.items():
        found = {x for x in r["labels"].split(",") if x in licenses.TEMPLATES}
        assert found == ({want[i]} if i in want else set()) and r["score"] == (1.0 if i in want else 0.0)


# 9: near duplicates

def classes(rows, threshold=0.8):
    """class and links of (doc_id, text) rows, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter((i, j) for who in holders.values() for a, i in enumerate(who) for j in who[a + 1:])
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (i, j), n in common.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (least[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates(spark, docs, texts, monkeypatch):
    rows = sorted(texts.items())
    base = " ".join(f"w{i}" for i in range(300)).split()
    rng = np.random.default_rng(9)
    for k in range(60):  # a large group of near copies, some just below and some above the threshold
        w = list(base)
        for p in rng.integers(0, 300, 1 + k % 7):
            w[p] = f"n{k}x{p}"
        rows.append((10_000 + k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1))
    want = classes(rows)
    for leaf, block in ((200, 512), (5, 16)):  # buckets that split, groups of several blocks
        monkeypatch.setattr(chosenpath, "LEAF", leaf)
        monkeypatch.setattr(chosenpath, "BUCKET_BLOCK", 16 if leaf == 5 else 4096)
        monkeypatch.setattr(chosenpath, "GROUP_BLOCK", block)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.near_duplicates(table).collect()}
        found, there = sum(n for _, n in got.values()), sum(n for _, n in want.values())
        assert all(got[d][1] <= want[d][1] for d in want) and found >= 0.99 * there
        assert sum(got[d] != want[d] for d in want) <= 0.02 * len(want)
    kept = chosenpath.keep_one(table)
    assert kept.columns == table.columns and kept.count() == len({c for c, _ in got.values()})


def test_exact_ties_link(spark):
    ties = [(12, 15), (36, 45), (44, 55), (96, 120)]
    rows = []
    for k, (common, union) in enumerate(ties):  # a text of so many grams and its own beginning, at 0.8 exactly
        w = [f"t{k}x{i}" for i in range(union + 4)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:common + 4]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == classes(rows) == {d: (d // 10 * 10, 1) for d, _ in rows}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = Counter(tuple(r) for r in chosenpath.near_duplicates(odd).collect())
    assert got == Counter({(1, 1, 0): 1, (2, 2, 0): 1, (3, 3, 1): 1, (4, 3, 1): 1, (None, None, 0): 1, (5, 5, 1): 2, (6, 6, 0): 1, (7, 7, 0): 1, (8, 8, 0): 1})
    assert sorted((r["doc_id"] or 0) for r in chosenpath.keep_one(odd).collect()) == [1, 2, 3, 5, 6, 7, 8]  # the row without an id is a copy
    assert chosenpath.near_duplicates(odd.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert (1 - chosenpath.survival(0.8, chosenpath.DEPTH)) ** chosenpath.runs_for(0.99) <= 0.01


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# 10: token counts

def test_rollup(spark, odd):
    root = new_path(spark, "rollup")
    one = [(1, "insert", 1, "v", "a", "en", 10), (2, "insert", 2, "v", "a", None, 5), (3, "insert", 2, "v", "a", None, 7), (1, "insert", None, "v", "a", "en", 9),
           (1, "delete", 9, "v", None, None, None), (1, "other", 3, "v", "a", "en", 9), (1, "insert", 4, None, "b", "en", None)]
    two = [(1, "revise", 1, "v", "b", "en", 4), (1, "delete", 2, "v", None, None, None), (1, "revise", 5, "w", "b", "en", 1)]
    frame = lambda rows: spark.createDataFrame(rows, rollup.CHANGES)
    now = lambda: sorted(map(tuple, rollup.totals(spark, root).collect()), key=str)
    assert now() == [] and rollup.commit(spark, root, "one", frame(one))
    assert now() == sorted([("a", "en", "v", 1, 10), ("a", None, "v", 1, 7), ("b", "en", None, 1, 0)], key=str)
    frame(two).write.parquet(f"{root}/batches/two/ledger")  # an interrupted batch
    assert rollup.commit(spark, root, "two", frame(two))
    after = sorted([("b", "en", "v", 1, 4), ("b", "en", "w", 1, 1), ("b", "en", None, 1, 0)], key=str)
    assert now() == after
    assert not rollup.commit(spark, root, "one", frame(one)) and not rollup.commit(spark, root, "two", frame(two)) and now() == after
    assert rollup.token_counts(odd.limit(0)).count() == 0
    twice = odd.union(odd).select("*", F.lit(0).alias("tokens"), F.lit("x").alias("version"))
    rows = rollup.token_counts(twice).groupBy("version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()
    plain = [r["text"] or "" for r in twice.collect()]
    assert {r["version"]: (r["docs"], r["tokens"]) for r in rows} == {
        "spaced": (len(plain), sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in plain)),
        "words": (len(plain), sum(len(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", t)) for t in plain))}


# Pipeline

def test_pipeline(spark, sf_dir, docs, texts):
    stage = docs
    before = None
    for name, f in corpus_pipeline.STAGES:
        before, stage = stage, f(spark, stage, sf_dir).cache()
        if name != "shards":
            assert stage.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    left = {i: t for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    unique = {i: left[i] for i, (c, _) in classes(sorted(left.items())).items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, x in zip(unique, overlap(unique.values(), items), strict=True) if not x[-1]}
    got = {r["doc_id"] for r in rows}
    assert got <= clean and len(rows) > len(got) > 0.6 * len(clean) and {r["shard"] for r in rows} <= set(range(16))
