"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window; the
largest response of each filter goes through a rectifier to a softmax over the
languages.  The network is trained with numpy on windows of a bounded sample of
labelled texts.  A text is all of its windows: their probabilities are averaged
by length, so every byte of every text has its say.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vdjloom.llm.shared import free_name
from vdjloom.llm.words import flat

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Texts that are learned from, for each language at most; windows of each; languages at most, by number of texts.
PER_LANGUAGE, WINDOWS, LANGUAGES = 1_000, 2, 200
#: The class of texts in no language, and the probability from which a text is held to be one.
NOISE, LEAST_NOISE = "\0noise", 0.9
STEPS, BATCH, RATE = 900, 64, 0.01
#: Windows that are scored together.
_GROUP = 1_024


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts, zero-padded: (windows, row of each, bytes in each)."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * WINDOW
    size = np.minimum(WINDOW, offsets[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    out = np.where(np.arange(WINDOW) < size[:, None], data[np.minimum(at, max(0, len(data) - 1))], 0) if len(row) else \
        np.zeros((0, WINDOW), np.uint8)
    return out.astype(np.uint8), row, size


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # by width: (width, 256, FILTERS), the filters' weights for each byte
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Each width's filters as tables over pairs of bytes: half as many look-ups."""
        made = []
        for t in self.tables:
            two = [(t[j][:, None] + t[j + 1][None]).reshape(65536, -1) for j in range(0, len(t) - 1, 2)]
            made.append(two + ([t[-1]] if len(t) % 2 else []))
        return made

    def probabilities(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        two = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for t, steps in zip(self.tables, pairs, strict=True):
            n = WINDOW - len(t) + 1
            total = None
            for k, table in enumerate(steps):
                at = two if table.shape[0] > 256 else x
                part = table[at[:, 2 * k:2 * k + n]]
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(axis=1))
        return softmax(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Fit a network to windows ``x`` and language numbers ``y`` by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    hidden = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    p += [np.zeros(hidden, np.float32), rng.normal(0, 0.3, (hidden, len(languages))).astype(np.float32),
          np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, STEPS + 1 if len(x) else 1):
        pick = rng.integers(0, len(x), BATCH)
        xb, yb = x[pick], y[pick]
        pooled, where = [], []
        for t, w in zip(p, WIDTHS, strict=False):
            n = WINDOW - w + 1
            a = sum(t[j][xb[:, j:j + n]] for j in range(w))
            at = a.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(a, at[:, None], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + p[-3]
        h = np.maximum(raw, 0)
        d = softmax(h @ p[-2] + p[-1])
        d[np.arange(BATCH), yb] -= 1
        d /= BATCH
        dh = (d @ p[-2].T) * (raw > 0)
        grads = []
        rows, filters = np.arange(BATCH)[:, None], np.arange(FILTERS)[None]
        for k, w in enumerate(WIDTHS):
            g = np.zeros_like(p[k])
            part = dh[:, k * FILTERS:(k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (xb[rows, where[k] + j], np.broadcast_to(filters, part.shape)), part)
            grads.append(g)
        grads += [dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network(languages, [a.astype(np.float32) for a in p[:len(WIDTHS)]], *(a.astype(np.float32) for a in p[len(WIDTHS):]))


def noise(windows: list[bytes], count: int, seed: int = 9) -> list[bytes]:
    """``count`` windows of no language: encodings, random bytes, and texts whose bytes are shuffled."""
    rng, out = np.random.default_rng(seed), []
    for i in range(count):
        raw = rng.integers(0, 256, WINDOW, dtype=np.uint8).tobytes()
        text = windows[int(rng.integers(0, len(windows)))]
        broken = b" ".join(raw[k:k + 16] for k in range(0, WINDOW, 16))
        kind = i % 8
        made = (base64.b64encode(raw) if kind == 0 else base64.b32encode(raw) if kind == 1 else raw.hex().encode() if kind == 2
                else b" ".join(b[:int(n)].hex().encode() for b, n in zip(broken.split(b" "), rng.integers(1, 9, 40), strict=False)) if kind == 3
                else base64.b85encode(raw) if kind == 4 else (np.frombuffer(raw, np.uint8) % 95 + 32).astype(np.uint8).tobytes() if kind == 5
                else raw if kind == 6 else rng.permutation(np.frombuffer(text, np.uint8)).tobytes())
        out.append(made[:len(text)])  # as long as texts are, so that length tells nothing
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, with_noise: bool = False) -> Network:
    """Learn from at most ``per_language`` texts of each language, chosen by hash of their id.

    ``with_noise`` adds a last class of that name, learned from made-up windows.  Only rows with text, lang and id that are not held out are learned from; of
    more than LANGUAGES languages, those with the most texts.
    """
    usable = docs.where("text IS NOT NULL AND text <> '' AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), ["und"])
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], int(min(1.0, 1.3 * per_language / r["count"]) * 1_000_000)).otherwise(share)
    picked = usable.withColumn("_h", F.xxhash64("doc_id", F.lit("langid"))).where(F.pmod("_h", F.lit(1_000_000)) < share)

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            sizes = np.diff(offsets)
            for k in range(WINDOWS):  # evenly over each text
                low = offsets[:-1] + np.maximum(0, sizes - WINDOW) * (2 * k + 1) // (2 * WINDOWS)
                cut = [data[a:min(a + WINDOW, b)].tobytes() for a, b in zip(low.tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cut, pa.binary())], ["h", "lang", "bytes"])

    got = picked.select("_h", "text", "lang").mapInArrow(run, "h bigint, lang string, bytes binary").toArrow()
    got = got.sort_by([("lang", "ascending"), ("h", "ascending"), ("bytes", "ascending")])
    names, raw = got["lang"].to_pylist(), got["bytes"].to_pylist()
    x, y = [], []
    for i, name in enumerate(languages):
        for cut in [b for n, b in zip(names, raw, strict=True) if n == name][:per_language * WINDOWS]:
            x.append(np.frombuffer(cut.ljust(WINDOW, b"\0"), np.uint8))
            y.append(i)
    if with_noise:
        made = noise(raw, per_language * WINDOWS)
        x += [np.frombuffer(cut.ljust(WINDOW, b"\0"), np.uint8) for cut in made]
        y += [len(languages)] * len(made)
        languages = [*languages, NOISE]
    y = np.array(y)
    # Languages weigh the same: rows of rarer ones are repeated.
    most = np.bincount(y).max()
    index = np.concatenate([np.resize(np.flatnonzero(y == i), most) for i in range(len(languages))])
    return train(np.stack(x)[index], y[index], languages)


def annotate(docs: DataFrame, network: Network, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability to the rows of ``docs`` (text).

    Null texts and texts without a letter are ``und`` with score 0.
    """
    # Plain arrays: a broadcast class would have to be importable on the executors.
    shared = docs.sparkSession.sparkContext.broadcast((network.languages, network.tables, network.bias, network.out, network.out_bias))
    mark = free_name(docs, "lettered")
    rows = docs.withColumn(mark, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    text = rows.columns.index("text")

    def run(batches):
        net = Network(*shared.value)
        pairs = net.pairs()
        for batch in batches:
            data, offsets = flat(batch.column(text))
            total = np.zeros((batch.num_rows, len(net.languages)))
            row0 = 0
            while row0 < batch.num_rows:
                row1 = max(row0 + 1, int(np.searchsorted(offsets, offsets[row0] + _GROUP * WINDOW, side="right")) - 1)
                row1 = min(row1, batch.num_rows)
                low = offsets[row0]
                # A very long text is taken some windows at a time.
                while True:
                    high = min(offsets[row1], low + 4 * _GROUP * WINDOW)
                    inner = np.clip(offsets[row0:row1 + 1], low, high)
                    x, row, size = windows(data, inner)
                    for k in range(0, len(x), _GROUP):
                        p = net.probabilities(x[k:k + _GROUP], pairs)
                        np.add.at(total, row0 + row[k:k + _GROUP], p * size[k:k + _GROUP, None])
                    low = high
                    if high >= offsets[row1]:
                        break
                row0 = row1
            best = total.argmax(axis=1)
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            share = total[np.arange(len(best)), best] / np.maximum(total.sum(axis=1), 1e-12)
            names = [net.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(lettered, share, 0.0))],
                [*batch.schema.names[:-1], pred, score])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()),
                                              T.StructField(score, T.DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` (doc_id, text, lang) and predict every row's language.

    Returns doc_id, held_out, lang_pred, score.  lang, source and doc_id are no
    inputs of a prediction; other columns are ignored.
    """
    network = fit(docs.select("doc_id", "text", "lang"))
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return annotate(slim, network).select("doc_id", "held_out", "lang_pred", "score")


def known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in a language.

    A text goes if it is null or has no letter, or if a network that also knows
    noise (encodings, random and shuffled bytes) gives that LEAST_NOISE or more
    over all of its windows; in doubt it stays.  Repeated rows and rows without an id are
    judged alike; an empty table stays empty; with no labelled row every text with a letter stays.
    """
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    network = fit(docs.select("doc_id", "text", "lang"), with_noise=True)
    if NOISE not in network.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = (F.col(pred) == "und") | ((F.col(pred) == NOISE) & (F.col(score) >= LEAST_NOISE))
    return annotate(docs, network, pred, score).where(~out).select(docs.columns)
