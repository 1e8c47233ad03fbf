"""Personal data: rules with exact offsets, and a BiLSTM-CRF that finds what they miss.

The rules give the base spans.  The network is trained on a bounded sample of
texts that the rules labelled, with further spellings written into them
("name (at) host dot org", numbers without a plus, defanged addresses).  It
reads every character of every text in overlapping windows; a character's tag
comes from the window in which it lies deeper, so a span is the same wherever
windows begin.  What it finds beside the base spans counts if it satisfies the
rule of its kind once the spelling is undone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vdjloom.llm import charcrf
from vdjloom.llm.words import flat

KINDS = ("email", "ip", "card", "phone")
#: Texts that are learned from, at most, and windows of each around a labelled span and elsewhere.
SAMPLE, LABELLED, PLAIN = 3_000, 2, 1
HIDDEN, STEPS, BATCH, LENGTH = 12, 600, 64, 64
#: How often each kind is written into a training text: e-mail has the most spellings, phone numbers the next.
WEIGHTS = (0.45, 0.1, 0.1, 0.35)
#: Characters of a window, and of each side that the next window reads again.
WINDOW, MARGIN = 192, 16
_GROUP = 1_024

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+" + _TAIL.pattern)
# A run of digits is tried as a whole: none of its ends would do better than its beginning.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"[+(]?[0-9][\x20()./0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in _TAIL.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def shapes(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches by kind, before their numbers are checked."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text)]
        out["card"] = [m.span() for m in _CARD.finditer(text)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text)]
    return out


def holds(kind: str, found: str) -> bool:
    """Whether a match of ``kind`` passes the check of its numbers."""
    if kind == "ip":
        return all(_small(p) for p in found.split("."))
    if kind == "card":
        digits = _digits(found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(_digits(found)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the rules' spans, by start, then kind."""
    found = shapes(text)
    return sorted(((a, b, k) for k, kind in enumerate(KINDS) for a, b in found[kind] if holds(kind, text[a:b])),
                  key=lambda s: (s[0], s[2]))


_AT = [re.compile(r"\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*", re.I), re.compile(r"\s+(?:at|@)\s+", re.I), re.compile(r"\s*@\s*")]
_DOT = [re.compile(r"\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*", re.I), re.compile(r"\s+(?:dot|\.)\s+", re.I)]


def undone(kind: str, found: str) -> bool:
    """Whether ``found`` is personal data of ``kind`` once its spelling is undone."""
    if kind == "email":
        for pattern in _AT:
            found = pattern.sub("@", found)
    if kind in ("email", "ip"):
        for pattern in _DOT:
            found = pattern.sub(".", found)
        return bool((_EMAIL if kind == "email" else _IP).fullmatch(found)) and holds(kind, found)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[\x20./_-]*[0-9])+", found)) and holds(kind, found)
    groups = re.findall("[0-9]+", found)
    return bool(_LOOSE_PHONE.fullmatch(found)) and len(groups) > 2 and max(map(len, groups)) < 9 and holds(kind, found)


# Training texts

def _tagged(text: str) -> np.ndarray:
    """A tag a character: 0, or 1 and the number of the kind; a card's digits inside another kind are that kind's."""
    tags = np.zeros(len(text), np.uint8)
    found = shapes(text)
    for kind in ("card", "phone", "ip", "email"):
        for a, b in found[kind]:
            if kind in ("email", "ip") or 9 + 3 * (kind == "card") <= len(_digits(text[a:b])) <= (19 if kind == "card" else 15):
                tags[a:b] = 1 + KINDS.index(kind)
    return tags


def _first_bytes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return data[(data & 0xC0) != 0x80]


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _name(rng, low: int, high: int) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(low, high)))


def spelled(rng, kind: str) -> str:
    """Personal data of ``kind`` in one of its spellings, the rules' own among them."""
    pick = lambda *options: options[rng.integers(0, len(options))]
    if kind == "email":
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "),
                       (" at ", " dot "), (" AT ", " DOT "), ("@", "(dot)"), ("@", "[.]"), ("{at}", "{dot}"))
        local = _name(rng, 3, 10) + pick("", "." + _name(rng, 2, 8), "." + _number(rng, 2), "_" + _name(rng, 2, 6), _number(rng, 2))
        host = [_name(rng, 3, 9) + pick("", _number(rng, 1)), *([_name(rng, 3, 9)] if rng.random() < 0.5 else []), pick("com", "org", "net", "de", "fr", "es", "io")]
        return local + at + dot.join(host)
    if kind == "ip":
        return pick(".", ".", "[.]", " . ", "(.)", "[dot]", " dot ").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        return pick("", " ", "-", ".", "  ", "/", "_").join([_number(rng, 4), _number(rng, 4), _number(rng, 4), _number(rng, 4)])
    area, mid, last = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return pick(f"+1 ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"({area}) {mid} {last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}",
                f"{area} {mid} {last}", f"1-{area}-{mid}-{last}", f"+{_number(rng, 2)} {_number(rng, 2)} {_number(rng, 4)} {_number(rng, 4)}",
                f"00{_number(rng, 2)} {_number(rng, 2)} {_number(rng, 4)} {_number(rng, 3)}", f"0{_number(rng, 2)}/{_number(rng, 4)}-{_number(rng, 3)}")


def plain(rng) -> str:
    """What looks like personal data and is none."""
    pick = lambda *options: options[rng.integers(0, len(options))]
    n = lambda k: _number(rng, k)
    year, hexes = str(rng.integers(1900, 2100)), "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, rng.integers(8, 41)))
    return pick(f"{year}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{year}", f"{n(2)}/{n(2)}/{year}", f"{n(2)}:{n(2)}:{n(2)}", f"{year}-{n(2)}-{n(2)} {n(2)}:{n(2)}",
                f"{n(1)}.{n(2)}.{n(1)}", f"v{n(1)}.{n(1)}", f"{n(3)},{n(3)},{n(3)}", f"{n(3)}.{n(2)}", n(4), n(7), n(9), n(10), f"{n(3)}-{n(4)}", f"{year}-{year}",
                hexes, f'token = "{hexes}"', f"0x{hexes}", f"#{n(6)}", f"@{_name(rng, 3, 9)}", f"{_name(rng, 3, 6)} at {_name(rng, 3, 6)}",
                f"{_name(rng, 3, 7)}.{_name(rng, 2, 4)}", f"({n(2)})", f"[{n(1)}]", f"{n(3)} {n(3)} {n(2)}", f"{n(1)}.{n(3)}.{n(3)}.{n(3)},{n(2)}",
                f"https://{_name(rng, 4, 8)}.com/{n(6)}", f"+{n(2)}", f"${n(2)}.{n(2)}", f"{n(5)}-{n(4)}", "AKIA" + hexes[:16].upper(), f"ISBN {n(3)}-{n(1)}")


def examples(windows: list[tuple[bytes, bytes]], seed: int = 11):
    """STEPS batches of (chars, tags), LENGTH wide: cuts of labelled ``windows``, into most of which something is written."""
    rng = np.random.default_rng(seed)
    blank = (b" " * LENGTH, b"\0" * LENGTH)
    for _ in range(STEPS):
        chars, tags = np.zeros((BATCH, LENGTH), np.uint8), np.zeros((BATCH, LENGTH), np.uint8)
        for i in range(BATCH):
            c, t = windows[rng.integers(0, len(windows))] if windows else blank
            low = int(rng.integers(0, max(1, len(c) - LENGTH + 1)))
            c, t = np.frombuffer(c, np.uint8)[low:low + LENGTH], np.frombuffer(t, np.uint8)[low:low + LENGTH]
            if (what := rng.random()) < 0.75:
                kind = int(rng.choice(4, p=WEIGHTS)) if what < 0.5 else None
                value = spelled(rng, KINDS[kind]) if kind is not None else plain(rng)
                into = np.frombuffer(value.encode(), np.uint8)
                gaps = np.flatnonzero((c == 32) & (t == 0))
                at = int(rng.choice(gaps)) if len(gaps) else 0
                around = rng.choice([b"  ", b"  ", b"  ", b"()", b'""', b" .", b" ,", b": ", b"\n\n", b" ;"])
                c = np.concatenate([c[:at], [around[0]], into, [around[1]], c[at:]])[:LENGTH]
                mark = np.full(len(into), 0 if kind is None else kind + 1)
                t = np.concatenate([t[:at], [0], mark, [0], t[at:]])[:LENGTH]
            chars[i, :len(c)], tags[i, :len(t)] = c, t
        yield chars, tags


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Learn from the rules' spans in at most ``sample`` texts of ``docs`` (doc_id, text), chosen by hash.

    The windows taken from a text are bounded in number and length, so what
    reaches the driver is.  Null and empty texts are not learned from.
    """
    usable = docs.where("text IS NOT NULL AND text <> ''")
    share = min(1.0, 1.3 * sample / max(1, usable.count()))
    key = F.xxhash64("doc_id", "text", F.lit("pii"))
    picked = usable.select(key.alias("h"), "text").where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches):
        for batch in batches:
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tags, chars = _tagged(text), _first_bytes(text)
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                edge = np.flatnonzero(np.diff(np.r_[0, tags]) > 0)
                centres = [*rng.permutation(edge)[:LABELLED].tolist(), *rng.integers(0, len(tags), PLAIN).tolist()]
                for k, at in enumerate(centres):
                    low = max(0, at - LENGTH)
                    out.append((h, k, chars[low:low + 2 * LENGTH].tobytes(), tags[low:low + 2 * LENGTH].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], ["h", "k", "chars", "tags"])

    got = picked.mapInArrow(run, "h bigint, k bigint, chars binary, tags binary").orderBy("h", "k").limit(
        sample * (LABELLED + PLAIN)).toArrow()
    model = charcrf.initial(HIDDEN, 1 + len(KINDS), seed=3)
    charcrf.train(model, examples(list(zip(got["chars"].to_pylist(), got["tags"].to_pylist(), strict=True))))
    return model


# Whole texts

def tags_of(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A tag a character for texts given as first bytes of their characters; ``model`` is prepared."""
    step = WINDOW - 2 * MARGIN
    sizes = np.diff(offsets)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - 2 * MARGIN) // step)), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start, end = offsets[:-1][row] + nth * step, offsets[1:][row]
    out = np.zeros(len(data), np.uint8)
    for k in range(0, len(row), _GROUP):
        part = slice(k, k + _GROUP)
        at = start[part, None] + np.arange(WINDOW)
        inside = at < end[part, None]
        chars = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        tags = charcrf.decode(model, chars)
        # Of what two windows read, each keeps its half; a text's ends have one window only.
        first, final = nth[part] == 0, nth[part] == count[row[part]] - 1
        where = np.arange(WINDOW)
        own = inside & ((where >= MARGIN) | first[:, None]) & ((where < WINDOW - MARGIN) | final[:, None]) & (tags > 0)
        out[at[own]] = tags[own]
    return out


def _runs(tags: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) of stretches of one tag inside one text, from the text's start."""
    marked = np.flatnonzero(tags)
    if not len(marked):
        return []
    row = np.searchsorted(offsets, marked, side="right") - 1
    fresh = np.r_[True, (np.diff(marked) > 1) | (np.diff(row) > 0) | (np.diff(tags[marked].astype(int)) != 0)]
    start, last = np.flatnonzero(fresh), np.r_[np.flatnonzero(fresh)[1:], len(marked)] - 1
    return [(int(r), int(a), int(b), int(t)) for r, a, b, t in zip(
        row[start], marked[start] - offsets[row[start]], marked[last] + 1 - offsets[row[start]], tags[marked[start]].astype(int) - 1, strict=True)]


def _added(text: str, base: list, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the network's stretches of one text, those that hold personal data beside the base spans."""
    out, edge = [], " \t\r\n,;:.\"'"
    for a, b, kind in found:
        while a < b and text[a] in edge:
            a += 1
        while a < b and text[b - 1] in edge:
            b -= 1
        # A word or number that is cut is taken whole.
        same = _LOCAL if kind == 0 else "0123456789"
        while 0 < a < b and text[a] in same and text[a - 1] in same:
            a -= 1
        while a < b < len(text) and text[b - 1] in same and text[b] in same:
            b += 1
        while a < b and text[b - 1] in edge:
            b -= 1
        if a < b and not any(x < b and a < y for x, y, _ in [*base, *out]) and undone(KINDS[kind], text[a:b]):
            out.append((a, b, kind))
    return out


def annotate(docs: DataFrame, model: dict[str, np.ndarray], name: str = "spans") -> DataFrame:
    """Add the spans of personal data in each text, by start, then kind: kind, start, end (characters), base.

    Null counts as an empty text, which has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(charcrf.prepared(model))  # plain arrays of a fixed size
    column = docs.columns.index("text")
    element = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                        T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))

    def run(batches):
        net = shared.value
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            texts = batch.column(column).fill_null("")
            data, offsets = flat(texts)
            low = offsets[0]
            data = data[low:offsets[-1]]
            first = (data & 0xC0) != 0x80
            before = np.zeros(len(data) + 1, np.int64)
            np.cumsum(first, out=before[1:])
            at = before[offsets - low]
            found = {}
            for r, a, b, k in _runs(tags_of(net, data[first], at), at):
                found.setdefault(r, []).append((a, b, k))
            out = []
            for r, text in enumerate(texts.to_pylist()):
                base = base_spans(text)
                more = _added(text, base, found[r]) if r in found else []
                both = [(a, k, b, True) for a, b, k in base] + [(a, k, b, False) for a, b, k in more]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": rule} for a, k, b, rule in sorted(both)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, element)]))


def redact(docs: DataFrame, spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce("text", F.lit(""))

    def put(s, x):
        more = F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), more.alias("out")))

    return F.aggregate(spans, state, put, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def _of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on a sample of ``docs`` (doc_id, text) and list the personal data of every row.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and
    spans (kind:start:end, comma-joined).  Repeated rows have a row each; null and
    empty texts have no spans; other columns are ignored.
    """
    slim = docs.select("doc_id", "text")
    found = annotate(slim, fit(slim, sample)).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[_of(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"))
