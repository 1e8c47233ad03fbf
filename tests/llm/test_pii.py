"""Personal data: rules against plain patterns, the network against slow sums, windows against whole texts, held-out spellings."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from vdjloom.llm import charcrf, pii

PATTERNS = {  # as the contract writes them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_rules(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            found, digits = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in found.split(".")) if kind == "ip" else 0,
                  "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def test_rules_equal_plain_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@@", ".", "1", "12", "255", "256", "0001", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
              " ", "-", "+", "+1 (906) 555-7738", "é", "x@y.z", "x@y.z@u.v", "+1", "(", ")", "\n", "_", "%", "3.4", "+1" * 3]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_rules(text), text
    assert pii.base_spans("١٢٣.1.1.1") == plain_rules("١٢٣.1.1.1".replace("١٢٣", "abc")) == []


def test_rules_are_linear_in_very_long_texts():
    for text in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000 + "x", "+1" + "(" * 400_000):
        pii.base_spans(text)


def _slow_scores(p, chars):
    hidden = p["inner"].shape[1]
    total = np.tile(p["bias"].astype(float), (len(chars), 1))
    for d, order in ((0, range(len(chars))), (1, range(len(chars) - 1, -1, -1))):
        h, c = np.zeros(hidden), np.zeros(hidden)
        for t in order:
            z = p["table"][d][chars[t]] + h @ p["inner"][d]
            f, i, o = (np.clip((z[k * hidden:(k + 1) * hidden] + 1) / 2, 0, 1) for k in range(3))
            c = f * c + i * np.clip(z[3 * hidden:], -1, 1)
            h = o * np.clip(c, -1, 1)
            total[t] += h @ p["out"][d]
    return total


@pytest.fixture(scope="module")
def random_net():
    p = charcrf.initial(4, 3, seed=2)
    rng = np.random.default_rng(3)
    return p | {k: rng.normal(0, 1, p[k].shape).astype(np.float32) for k in ("step", "first", "last", "bias")}


def test_decoding_equals_all_paths(random_net):
    chars = np.random.default_rng(4).integers(97, 101, (40, 6)).astype(np.uint8)
    q = charcrf.prepared(random_net)
    got = charcrf.decode(q, chars)
    for n, row in enumerate(chars):
        e = _slow_scores(random_net, row)
        assert np.allclose(charcrf.tag_scores(q, chars)[:, :, n], e, atol=1e-4)
        value = lambda y: (random_net["first"][y[0]] + random_net["last"][y[-1]] + sum(e[t, y[t]] for t in range(6))  # noqa: B023, E731
                           + sum(random_net["step"][a, b] for a, b in itertools.pairwise(y)))
        best = max(itertools.product(range(3), repeat=6), key=value)
        assert value(tuple(got[n])) > value(best) - 1e-3


def test_slopes_equal_differences(random_net):
    p = {k: v.astype(np.float64) for k, v in random_net.items()}
    rng = np.random.default_rng(5)
    x, y = rng.integers(60, 70, (4, 7)).astype(np.uint8), rng.integers(0, 3, (4, 7)).astype(np.uint8)
    _, g = charcrf.loss_and_slopes(p, x, y)
    for name, slope in g.items():
        flat = p[name].reshape(-1)
        for i in np.argsort(-np.abs(slope).ravel())[:3]:
            keep, sides = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = keep + step
                sides.append(charcrf.loss_and_slopes(p, x, y)[0])
            flat[i] = keep
            assert abs((sides[0] - sides[1]) / 2e-3 - slope.ravel()[i]) < 0.01 * max(1, abs(slope.ravel()[i]))


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return pii.fit(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text"))


def test_every_character_of_a_long_text_is_read(model):
    """A text's tags don't depend on the texts beside it, and its windows meet everywhere."""
    q = charcrf.prepared(model)
    rng = np.random.default_rng(6)
    texts = ["", "x", "lorem ipsum " * 3, *("lorem ipsum dolor " * n + "call (906) 555-7738 now " + "sit amet " * n for n in (1, 9, 23, 200))]
    data = [pii._first_bytes(t) for t in texts]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])]
    together = pii.tags_of(q, np.concatenate(data), offsets)
    for d, a, b in zip(data, offsets[:-1], offsets[1:], strict=True):
        assert (pii.tags_of(q, d, np.array([0, len(d)])) == together[a:b]).all()
    found = {r for r, *_ in pii._runs(together, offsets)}
    assert found == {3, 4, 5, 6}
    at = [pii.tags_of(q, d, np.array([0, len(d)])).nonzero()[0][:1] for d in (
        pii._first_bytes("word " * int(n) + "(906) 555-7738" + " word" * 60) for n in rng.integers(0, 90, 30))]
    assert all(len(a) == 1 for a in at)


def test_spellings_are_found_and_look_alikes_left_alone(spark, sf_dir, model):
    held = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").where("length(text) > 300").select("text").limit(600).collect()
    rng, rows, kinds = np.random.default_rng(8), [], {}
    for i, r in enumerate(held):
        gaps = [j for j, c in enumerate(r.text) if c == " "]
        at, kind = int(rng.choice(gaps)), [*pii.KINDS, None, None][i % 6]
        value = pii.plain(rng) if kind is None else pii.spelled(rng, kind)
        kinds[i] = kind, at + 1, at + 1 + len(value), kind is not None and pii.undone(kind, value)
        rows.append((i, r.text[:at + 1] + value + r.text[at:]))
    got = {r.doc_id: r for r in pii.annotate(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    seen, due, wrong = {k: 0 for k in pii.KINDS}, {k: 0 for k in pii.KINDS}, 0
    for i, (kind, a, b, valid) in kinds.items():
        spans = got[i].spans
        base = [(s.start, s.end, pii.KINDS.index(s.kind)) for s in spans if s.base]
        assert base == pii.base_spans(got[i].text) == plain_rules(got[i].text)
        inside = [s for s in spans if s.start < b and a < s.end]
        if valid:
            due[kind] += 1
            seen[kind] += any(s.kind == kind for s in inside)
        elif kind is None:
            wrong += any(not s.base for s in inside)
    assert wrong <= 3
    for kind, least in (("email", 0.75), ("ip", 0.85), ("card", 0.85), ("phone", 0.75)):
        assert seen[kind] >= least * due[kind], (seen, due)
    again = pii.annotate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), model).collect()
    assert {r.doc_id: r.spans for r in again} == {i: r.spans for i, r in got.items()}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 60)
    rows = [(1, None, "x"), (2, "", "x"), (None, "mail a@b.cd", "x"), (3, "mail a@b.cd", "x"), (3, "mail a@b.cd", "x"),
            (4, "é" * 50_000 + " +1 (906) 555-7738 " + "word " * 40_000 + "4111 1111 1111 1111", "x"), (5, "10.0.0.1 and 10.0.0.256 ", "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = pii.personal_data(table)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[3]) == 2 and by[3][0] == by[3][1] and by[None][0].spans == "email:5:11"
    empty = hashlib.sha256(b"").hexdigest()
    assert [(by[i][0].base_sha256, by[i][0].spans) for i in (1, 2)] == [(empty, "")] * 2
    long = by[4][0]
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in plain_rules(rows[5][1]))
    assert (long.n_phone, long.n_card, long.base_sha256) == (1, 1, hashlib.sha256(base.encode()).hexdigest()) and base in long.spans
    assert (by[5][0].n_ip, by[5][0].spans) == (1, "ip:0:8")
    assert pii.personal_data(table.limit(0)).count() == 0
    model = pii.fit(table)
    clean = pii.annotate(table.drop("spans"), model)
    assert {r[0] for r in clean.where("doc_id = 5 OR doc_id IS NULL").select(pii.redact(clean)).collect()} == {
        "[ip] and 10.0.0.256 ", "mail [email]"}
