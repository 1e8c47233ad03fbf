"""License scans: phrases, and templates found by an exact set-similarity join.

A text block holds a template if it has at least ``threshold`` of the
template's words.  Blocks are the lines, and for wrapped notices the windows of
SPAN times as many consecutive words as the template has, wherever lines break.
Only texts that as a whole pass the filters below are looked at by window.
Words are ordered by how often they occur in all texts,
rarest first.  A block that meets the threshold shares a word with the
template's prefix, so only blocks with such a word are joined (prefix filter);
a pair goes on if the block has enough words (length filter) and enough words
are left on both sides after the first shared one (positional filter); then the
overlap is counted.  Words in no template can't add to an overlap and are left
out, which changes no result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.functions.binding import bind

# Phrases and their labels, then license notices as their publishers word them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "notice-apache-2": "Licensed under the Apache License, Version 2.0.",
    "notice-cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "notice-gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "notice-mit": "Released under the MIT License.",
    "text-apache-2": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                     "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "text-gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                  "or (at your option) any later version.",
    "text-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files, to deal in the Software without restriction.",
}

THRESHOLD = 0.9
#: Words of a window for each word of the template: room for what comment marks and edits add to a wrapped notice.
SPAN = 2

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _place(phrase: str) -> str:
    return rf"(?<!{_WORD})" + _GAP.join(f"(?i:{w})" for w in phrase.split()) + rf"(?!{_WORD})"


def _words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD + "+")).cast("bigint")


def _sequence(template: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.translate(str.maketrans(_UPPER, _LOWER)))


def _tokens(template: str) -> list[str]:
    return sorted(set(_sequence(template)))


def phrases(docs: DataFrame, named: Mapping[str, str] = PHRASES) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base (sorted labels) to docs with text, never null."""
    text = F.col("text")
    any_place = "(?:" + "|".join(map(_place, named)) + ")"
    # A phrase can only be where one of its words is; a plain search for the longest spares most texts the pattern.
    keys = sorted({max(p.split(), key=len) for p in named})
    low = F.lower(text)
    may = low.contains(keys[0])
    for k in keys[1:]:
        may = may | low.contains(k)
    none = F.lit(None).cast("bigint")
    counted = bind(docs, {"n_words": _words_in(text), "n_base": F.when(may, F.regexp_count(text, F.lit(any_place))).otherwise(0).cast("bigint")})
    has = F.col("n_base") > 0
    labels = F.array_compact(F.array(*[F.when(has & text.rlike(_place(p)), F.lit(n)) for p, n in named.items()]))
    return counted.withColumns({
        "first_word": F.when(has, _words_in(F.regexp_extract(text, rf"(?s)^(.*?){any_place}", 1))).otherwise(none),
        "last_word": F.when(has, _words_in(F.regexp_extract(text, rf"(?s)^(.*){any_place}", 1))).otherwise(none),
        "base": F.array_sort(F.array_distinct(labels))})


def _order(docs: DataFrame, universe: list[str]) -> list[str]:
    """Words of the templates, rarest in all texts first; of equally rare ones, by code point."""
    word = F.translate("w", _UPPER, _LOWER)
    counts = (
        docs.select(F.explode(F.split("text", _GAP)).alias("w")).where(F.lower("w").isin(universe))
        .select(word.alias("w")).groupBy("w").count().collect())  # a row for each template word at most
    times = {r["w"]: r["count"] for r in counts}
    return sorted(universe, key=lambda w: (times.get(w, 0), w))


def containing(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Template matches of the lines and word windows of ``docs`` (key, text): key, template, containment."""
    spark = docs.sparkSession
    sets = {name: t for name, text in templates.items() if (t := _tokens(text))}
    order = _order(docs, sorted(set().union(*sets.values())))
    rank = {w: i for i, w in enumerate(order)}
    rows, prefixes = [], set()
    for name, words in sets.items():
        ranks = sorted(rank[w] for w in words)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        for i, r in enumerate(ranks[:len(ranks) - need + 1]):
            prefixes.add(order[r])
            rows.append(F.struct(F.lit(name).alias("template"), F.lit(r).alias("r"), F.lit(i).alias("i"),
                                 F.lit(ranks).alias("t"), F.lit(need).alias("need"),
                                 F.lit(SPAN * len(_sequence(templates[name]))).alias("span")))
    prefix = spark.range(1).select(F.inline(F.array(*rows)))
    seen = rf"(?<!{_WORD})(?i:{'|'.join(sorted(prefixes))})(?!{_WORD})"
    quick = F.lit(False)
    for w in sorted(prefixes):
        quick = quick | F.lower("text").contains(w)
    near = docs.where(quick).where(F.col("text").rlike(seen))
    lines = near.select("key", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(seen))
    ranks_of = F.map_from_arrays(F.lit(order), F.lit(list(range(len(order)))))
    split = lambda text: F.split(F.translate(text, _UPPER, _LOWER), _GAP)
    rank_in = lambda w: F.element_at(ranks_of, w)

    def pairs(blocks: DataFrame) -> DataFrame:
        n, m = F.size("b"), F.size("t")
        return (
            blocks.select(*blocks.columns, F.posexplode("b").alias("j", "r"))
            .join(prefix, "r")  # the templates' prefixes: a few rows that the caller names
            .where((n >= F.col("need")) & (F.lit(1) + F.least(m - F.col("i") - 1, n - F.col("j") - 1) >= F.col("need")))
            .where(F.size(F.array_intersect("b", "t")) >= F.col("need")))

    mine = F.array_sort(F.array_compact(F.transform(F.array_distinct(split("line")), rank_in)))
    of_lines = pairs(bind(lines, {"b": mine}).drop("line")).select(
        "key", "template", (F.size(F.array_intersect("b", "t")) / F.size("t")).alias("containment"))
    # A text that lacks the words as a whole has no window with them; it is taken once, at the first shared word.
    all_words = F.array_sort(F.transform(F.array_intersect(split("text"), F.lit(order)), rank_in))
    first = F.get(F.array_intersect("b", "t"), F.lit(0))
    whole = bind(pairs(bind(near, {"b": all_words})).where(first == F.col("r")), {"w": F.transform(split("text"), rank_in)})
    window = lambda p: F.size(F.array_intersect(F.slice("w", p, F.col("span")), "t"))
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda p: F.array_contains("t", F.get("w", p - 1)))
    of_windows = bind(whole, {"best": F.array_max(F.transform(starts, window))}).where("best >= need").select(
        "key", "template", (F.col("best") / F.size("t")).alias("containment"))
    return of_lines.unionByName(of_windows).groupBy("key", "template").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses in every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word
    (their smallest and largest start; null without one), base_labels, labels
    (with the names of the templates a block holds) and score: 1 with a phrase,
    else the largest share of a template found, else 0.  Null text counts as
    empty; equal texts get equal results, whatever their ids; other columns are
    ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.md5("text"))
    found = containing(keyed.select("key", "text"), templates, threshold).groupBy("key").agg(
        F.collect_set("template").alias("more"), F.max("containment").alias("best"))
    base = phrases(keyed).drop("text")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return base.join(found, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql() -> str:
    places = " + ".join(
        "len(list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())) + "))"
        for p in PHRASES)
    starts = "list_concat(" * (len(PHRASES) - 1)
    for k, p in enumerate(PHRASES):
        one = "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())) + ")"
        starts += one if k == 0 else f", {one})"
    labels = "list_concat(" * (len(PHRASES) - 1)
    for k, (p, n) in enumerate(PHRASES.items()):
        one = (f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ') THEN ['{n}'] ELSE []::VARCHAR[] END")
        labels += one if k == 0 else f", {one})"
    ts = ", ".join(f"('{n}', {_tokens(t)!r})" for n, t in TEMPLATES.items())
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate({}, '" + _UPPER + "', '" + _LOWER + "')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all({low.format('text')}, {pattern}) AS w FROM d),
b AS (SELECT rid, doc_id, len(w) AS n_words, {places} AS n_base, {starts} AS places,
             list_sort(list_distinct({labels})) AS base FROM w),
l AS (SELECT rid, regexp_extract_all({low.format('line')}, {pattern}) AS t
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) x
      WHERE regexp_matches(line, '(?i)licen|free|software|hereby|warrant|cc')),
t AS (SELECT * FROM (VALUES {ts}) v(template, s)),
m AS (SELECT rid, template, max(len(list_intersect(l.t, t.s)) / len(t.s)) AS c FROM l, t
      WHERE len(list_intersect(l.t, t.s)) >= {THRESHOLD} * len(t.s) - 1e-9 GROUP BY ALL),
g AS (SELECT rid, list(template) AS more, max(c) AS best FROM m GROUP BY rid)
SELECT doc_id, n_words, n_base::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(base, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, []::VARCHAR[])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN g USING (rid)
"""


SQL = _sql()
