"""The conversation trie against SQL and a brute force over tuples of turns."""

import hashlib
import random
import re
import zlib

import pytest

from vdjloom.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, c int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for p, who in members.items():
        under = [q for q in members if q[:len(p)] == p]
        childless = lambda q: not any(x[:-1] == q and x for x in members)
        ends = ",".join(str(c) for c in sorted(who) if built[c] == p)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), sum(1 for q in members if q and q[:-1] == p),
                    sum(childless(q) for q in under), sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rows_like(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), " ".join(rng.choices(words, k=rng.randrange(3))), "x", 1))
    return rows


ODD = [
    (None, 0, "user", "lost", "x", 1), (0, None, "user", "null turn first", "x", 1), (0, 0, None, None, "x", 1), (0, 0, "", "", "x", 1),
    (0, 1, "user", "same", "x", 1), (0, 1, "user", "same", "x", 1), (0, 1, "bot", "tie", "x", 1), (3, 5, "user", "a  b\tc\x0bd", "x", 1),
    (-5, 0, "user", "minus", "x", 1), (-5, 1, "user", "é ü x", "x", 1), (-20, 0, "user", "base", "x", 1), (2**62, 0, "user", "large id", "x", 1),
    (41, 0, "user", "without a base", "x", 1), (42, 0, "user", "w " * 50_000, "x", 1), (17, 0, "1", ":2", "x", 1), (18, 0, "1:", "2", "x", 1),
]


@pytest.mark.parametrize("case", ["odd", "shared", "long", "many"])
def test_trie_equals_brute_force(spark, monkeypatch, case):
    rows = {
        "odd": ODD,
        "shared": rows_like(1, range(-25, 60), ["a", "b"]) + ODD,
        # One conversation with most of the rows, cut into slices, chains longer than a slab, lists of several pieces.
        "long": [(7, t, "user", str(t % 3), "x", 1) for t in range(150)] + rows_like(2, range(20), ["0", "1"]),
        "many": [(c, t, "user", "same", "x", 1) for c in range(60) for t in range(5)] + rows_like(3, range(60, 90), ["same"]),
    }[case]
    monkeypatch.setattr(prefixtrie, "PIECE_BITS", 3)
    monkeypatch.setattr(prefixtrie, "SLAB", 4)
    got = prefixtrie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_block_size_changes_nothing_and_empty_table(spark):
    table = spark.createDataFrame(rows_like(4, range(40), ["a", "b"]), SCHEMA)
    one, four = (sorted(map(tuple, prefixtrie.trie(table, block=b).collect()), key=str) for b in (1, 4))
    assert one == four
    assert prefixtrie.trie(table.limit(0)).count() == 0
