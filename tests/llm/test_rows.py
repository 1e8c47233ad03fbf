"""Rows that share an id, odd ids, texts in no language, and executors that lack the package."""

import base64
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import oracle
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vdjloom.llm import chosenpath, langid, mixing, search, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _against_sql(tmp_path, name, table, df, sql):
    pq.write_table(table.toArrow(), tmp_path / f"{name}.parquet")
    names, ours = oracle.run_spark(df)
    return oracle.difference(names, ours, oracle.connect(str(tmp_path)), sql)


def test_every_row_is_query_and_candidate(spark, tmp_path):
    rows = [(i, [float(a), float(b)]) for i, a, b in ((20, 1, 0), (20, 1, 0), (20, 0, 1), (1, 1, 1), (1, 2, 0), (2, 0, 0), (40, -1, 3))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = search.top_k(table)
    assert out.count() == 4 * 6
    assert _against_sql(tmp_path, "embeddings", table, out, search.SQL) == ""


def test_large_page_ids(spark, tmp_path):
    table = spark.createDataFrame([(2 ** 63 - 1, "http://a.b/", "x"), (-2 ** 63, "http://a.b/", "x"), (10 ** 12, "http://c.d/", "y"), (3, "u", None)],
                                  "page_id bigint, url string, html string")
    assert _against_sql(tmp_path, "pages", table, warc.capture_history(table), warc.SQL) == ""


def test_rows_without_an_id_meet_the_target(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"w{i} " * 10, "en", "a" if i % 3 else "b", 1) for i in range(3000)]
    table = spark.createDataFrame(rows, DOCS)
    out = mixing.summary(table.withColumn("n_chars", F.lit(1)))
    by = out.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(by) == 2 and all(abs(r.taken - r.target) < 0.06 * r.target for r in by)
    assert _against_sql(tmp_path, "documents", table, out, mixing.SQL) == ""


def test_one_of_each_class_whatever_the_ids(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 60))
    a, b, c, d = text(), text(), text(), text()
    near = b.rsplit(" ", 1)[0]
    rows = [(1, a), (1, b), (2, near), (3, c), (3, c), (4, a), (None, c), (None, d), (None, d), (5, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"_kept": F.lit(7), "_first": F.lit(8), "id": F.lit(9), "row": F.lit(1), "own": F.lit(2)})
    kept = chosenpath.keep_one(table)
    assert kept.columns == table.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert got == sorted([(1, a, 7, 8, 9, 1, 2), (1, b, 7, 8, 9, 1, 2), (3, c, 7, 8, 9, 1, 2), (None, d, 7, 8, 9, 1, 2),
                          (5, None, 7, 8, 9, 1, 2), (5, "", 7, 8, 9, 1, 2)], key=str)
    classes = {(r.doc_id, r.class_id, r.n_links) for r in chosenpath.near_duplicates(table).collect()}
    assert classes == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 1, 1), (None, None, 0), (5, 5, 0)}


def test_language_stage_rejects_noise_and_keeps_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rng = np.random.default_rng(77)
    raw = [rng.integers(0, 256, 300, dtype=np.uint8).tobytes() for _ in range(50)]
    letters = [bytes(r).decode("latin1") for r in raw]
    texts = [r.text for r in docs.where("length(text) > 300").orderBy(F.desc("doc_id")).limit(50).collect()]
    noise = ([base64.b64encode(r).decode() for r in raw] + [r.hex() for r in raw] + [base64.b32encode(r).decode() for r in raw]
             + ["".join(rng.permutation(list(t))) for t in texts] + letters)
    table = docs.unionByName(spark.createDataFrame([(10 ** 9 + i, t, None, "noise", 1) for i, t in enumerate(noise)], DOCS))
    kept = langid.known(table)
    assert kept.columns == docs.columns
    clean, left = kept.where("doc_id < 1000000000").count(), kept.where("doc_id >= 1000000000").count()
    assert left <= 0.1 * len(noise), left
    assert clean >= 0.995 * docs.where("text rlike '\\\\p{L}'").count()


def test_scores_equal_plain_sums():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(0.3, np.full(1 << toxicity.BITS, -1, np.int32), rng.normal(0, 1, 30), rng.normal(0, 0.5, (30, toxicity.FACTORS)))
    known = rng.choice(1 << toxicity.BITS, 30, replace=False)
    m.slot[known] = np.arange(30)
    sets = [np.unique(rng.choice(np.r_[known, rng.integers(0, 1 << toxicity.BITS, 30)], n)) for n in (1, 2, 9, 25)]
    got = m.score(np.repeat([0, 1, 3, 4], [len(s) for s in sets]), np.concatenate(sets), 6)
    for row, terms in zip((0, 1, 3, 4), sets, strict=True):
        at = [m.slot[t] for t in terms if m.slot[t] >= 0]
        z = 0.3 + sum(m.weight[i] for i in at) + sum(float(m.factor[i] @ m.factor[j]) for n, i in enumerate(at) for j in at[:n])
        assert got[row] == pytest.approx(1 / (1 + np.exp(-z)))
    assert got[2] == got[5] == pytest.approx(1 / (1 + np.exp(-0.3)))


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(4)
    hidden = langid.FILTERS * len(langid.WIDTHS)
    net = langid.Network(["a", "b", "c"], [rng.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS],
                         rng.normal(0, 1, hidden).astype(np.float32), rng.normal(0, 1, (hidden, 3)).astype(np.float32), np.zeros(3, np.float32))
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    got = net.probabilities(x, net.pairs())
    for row, window in zip(got, x, strict=True):
        pooled = [max(sum(float(t[j, window[i + j], f]) for j in range(len(t))) for i in range(langid.WINDOW - len(t) + 1))
                  for t in net.tables for f in range(langid.FILTERS)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out
        assert np.allclose(row, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-3)


def test_executors_without_the_package(sf_dir, tmp_path):
    """Workers start in an empty folder and can't import the package; the driver alone has it."""
    repo = Path(__file__).resolve().parents[2]
    script = f"""
import sys
sys.path[:0] = [{str(repo)!r}, {str(repo / 'tests')!r}]
from conftest import session
import __spark_entry__ as driver
spark = session()
for name in ("op2_toxicity", "op3_language", "op7_decontaminate", "op11_personal_data", "op13_hard_negatives", "pipeline"):
    print(name, driver.queries()[name](spark, {sf_dir!r}).count(), flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.strip().splitlines()) >= 6
