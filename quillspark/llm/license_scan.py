"""License scan: exact phrases, and an exact set-similarity join of text blocks with templates (native).

Blocks are a document's lines. A template is found in a block that contains at least ``share`` of
its distinct words. The join follows from the usual filters, none of which loses a match:

* prefix: words are ordered by their frequency in the corpus, the rarest first, in templates and in
  blocks (a block's words that are in no template never count). A match must hold one of a template's first
  size - need + 1 words among the block's first n - need + 1, so documents without any such word are
  never cut into lines, and lines meet templates by an equi-join on those words;
* length: the block must have at least ``need`` distinct words of templates;
* position: a match whose first common word is the template's i-th and the block's j-th must leave at
  least ``need`` words from there on in both; pairs failing that are dropped before they are verified.

Word frequencies are counted over all documents, once a scan.

With ``wrapped`` (the query's form), notices that run across line ends are found too: a span of as
many consecutive words as the template has, divided by ``share`` (room for words between), must hold
``need`` of its distinct words. Any such span holds a word of the prefix, so the words around each
of these are compared, with every place of the span in them. A label found only so counts as one block.
Texts go on in stretches of ``STRETCH`` words, each with the words that spans from it can reach, so that a
row's memory grows with its text and not with the spans in it.

Defined cases: null counts as empty (no words, no labels, score 0); null ids and repeated rows are
kept; wholly equal rows get equal results; very long texts are read whole; words of equal frequency are
ordered by themselves; an empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Between words: every ASCII character but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
SHARE = 0.8
#: The places of so many words are listed at once.
STRETCH = 512
#: Well-known notices, as words in lower case; the label is the method's own.
TEMPLATES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-release", "released under the mit license"),
    ("apache-2-notice", "licensed under the apache license version 2 0"),
    ("apache-2-copy", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text):
    return F.split(text, GAP)


def template_rows(frequency: dict[str, int], templates=TEMPLATES, share: float = SHARE) -> list[tuple]:
    """(label, words from the rarest up, size, need, length of the prefix) of every template."""
    out = []
    for label, text in templates:
        words = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        need = math.ceil(share * len(words) - 1e-9)
        out.append((label, words, len(words), need, len(words) - need + 1))
    return out


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates stands, over all documents."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    known = F.array(*map(F.lit, vocabulary))
    own = docs.select(F.explode(F.array_intersect(_split(F.lower("text")), known)).alias("w"))
    return {r["w"]: r["n"] for r in own.groupBy("w").agg(F.count("*").alias("n")).collect()}  # the templates' words


def _index(spark: SparkSession, prefix: list[tuple], names: list[str]) -> DataFrame:
    """The templates' prefixes as a table, by Arrow: a list of rows would start Python workers in every executor."""
    return spark.createDataFrame(pa.table([pa.array(c, pa.int32() if isinstance(c[0], int) else None) for c in zip(*prefix)], names))


def prefix_pairs(
    spark: SparkSession, docs: DataFrame, templates=TEMPLATES, share: float = SHARE, frequency: dict[str, int] | None = None
) -> DataFrame:
    """Lines and templates that share a word of both prefixes, with its place in each (i, j) and all their words.

    ``docs`` has doc_id and text; th is the text's hash, which with the id names the document. A line's
    words are those of any template, from the rarest in the corpus up, like a template's. ``frequency`` is
    that of :func:`frequencies`, if known.
    """
    frequency = frequencies(docs, templates) if frequency is None else frequency
    rows = template_rows(frequency, templates, share)
    prefix = [(w, label, i, size, need, words) for label, words, size, need, k in rows for i, w in enumerate(words[:k])]
    index = _index(spark, prefix, ["w", "label", "i", "size", "need", "words"])
    rare = F.array(*(F.lit(w) for w in sorted({p[0] for p in prefix})))
    order = sorted({w for r in rows for w in r[1]}, key=lambda w: (frequency.get(w, 0), w))
    near = docs.filter(F.arrays_overlap(_split(F.lower("text")), rare))
    lines = near.select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        F.posexplode(F.split(F.translate("text", UPPER, LOWER), "\n")).alias("line", "block"),
    )
    least = min(r[3] for r in rows)
    blocks = lines.select("doc_id", "th", "line", F.array_intersect(F.array(*map(F.lit, order)), _split(F.col("block"))).alias("tokens"))
    blocks = blocks.filter(F.size("tokens") >= least)
    # a line brings only the words of its prefix to the join
    brought = F.slice("tokens", F.lit(1), F.size("tokens") - (least - 1))
    return blocks.select("*", F.posexplode(brought).alias("j", "w")).join(F.broadcast(index), "w")


def may_match():
    """Length and position: both sides must have enough words, and enough of them from their first common word on."""
    n = F.size("tokens")
    return (n >= F.col("need")) & (F.least(F.col("size") - F.col("i"), n - F.col("j")) >= F.col("need"))


def matches(
    spark: SparkSession, docs: DataFrame, templates=TEMPLATES, share: float = SHARE, frequency: dict[str, int] | None = None
) -> DataFrame:
    """(doc_id, th, line, label, containment): every block that reaches a template's share."""
    met = prefix_pairs(spark, docs, templates, share, frequency).filter(may_match())
    # the first common word alone carries a pair on, so each pair is verified once
    common = F.array_intersect("words", "tokens")
    met = met.filter(F.element_at(common, 1) == F.col("w")).withColumn("common", F.size(common))
    return met.filter("common >= need").select("doc_id", "th", "line", "label", (F.col("common") / F.col("size")).alias("containment"))


def spans(
    spark: SparkSession, docs: DataFrame, templates=TEMPLATES, share: float = SHARE, frequency: dict[str, int] | None = None
) -> DataFrame:
    """(doc_id, th, label, containment): every template that spans of a document reach, across line ends."""
    frequency = frequencies(docs, templates) if frequency is None else frequency
    rows = template_rows(frequency, templates, share)
    length = {label: math.ceil(len(text.split()) / share - 1e-9) for label, text in templates}
    longest = max(length.values())
    prefix = [(w, label, length[label], size, need, words) for label, words, size, need, k in rows for w in words[:k]]
    index = _index(spark, prefix, ["w", "label", "len", "size", "need", "words"])
    rare = F.array(*(F.lit(w) for w in sorted({p[0] for p in prefix})))
    near = docs.filter(F.arrays_overlap(_split(F.lower("text")), rare))
    words = F.filter(_split(F.translate("text", UPPER, LOWER)), lambda x: x != "")
    near = near.select("doc_id", F.xxhash64("text").alias("th"), words.alias("all"))

    def stretch(at):
        start = F.greatest(at - (longest - 1), F.lit(0))
        return F.struct((at - start).alias("at"), F.slice("all", start + 1, at - start + STRETCH + longest - 1).alias("all"))

    firsts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(STRETCH))
    near = near.select("doc_id", "th", F.explode(F.transform(firsts, stretch)).alias("s")).select("doc_id", "th", "s.*")
    own = F.transform(F.slice("all", F.col("at") + 1, F.lit(STRETCH)), lambda x, i: F.struct(x.alias("w"), (i + F.col("at")).alias("i")))
    places = F.filter(own, lambda a: F.array_contains(rare, a["w"]))

    def around(a):
        start = F.greatest(a["i"] - (longest - 1), F.lit(0))
        return F.struct(a["w"].alias("w"), F.slice("all", start + 1, a["i"] - start + longest).alias("around"))

    near = near.select("doc_id", "th", F.explode(F.transform(places, around)).alias("a")).select("doc_id", "th", "a.*")
    met = near.join(F.broadcast(index), "w").filter(F.size(F.array_intersect("words", "around")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("around") - F.col("len") + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect("words", F.slice("around", k, F.col("len"))))))
    met = met.withColumn("common", best).filter("common >= need")
    return met.groupBy("doc_id", "th", "label").agg(F.max(F.col("common") / F.col("size")).alias("containment"))


def _stands(parts: list[str]):
    """Whether a phrase's words stand in column w from a place on."""

    def here(i):
        test = F.get("w", i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & F.coalesce(F.get("w", i + k) == part, F.lit(False))
        return test

    return here


def scan(
    spark: SparkSession, docs: DataFrame, templates=TEMPLATES, share: float = SHARE, phrases=PHRASES, wrapped: bool = False
) -> DataFrame:
    """Phrase counts and places, labels and score of every row of (doc_id, text).

    Templates are sought in lines, and across line ends if ``wrapped``.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), _split("text").alias("p"))
    head = F.when(F.get("p", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("p") > 1) & (F.element_at("p", -1) == ""), 1).otherwise(0)
    d = d.withColumn("n_words", (F.size("p") - head - tail).cast("long"))
    # a cheap test that every text with a phrase passes; lower() only errs towards more texts
    low = F.lower("text")
    maybe = F.lit(False)
    for phrase, _ in phrases:
        maybe = maybe | F.contains(low, F.lit(max(phrase.split(), key=len) if len(phrase) > 10 else phrase.split()[0]))
    w = F.filter(_split(F.translate("text", UPPER, LOWER)), lambda x: x != "")
    d = d.withColumn("w", F.when(maybe, w))
    found = []
    for phrase, label in phrases:
        places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), _stands(phrase.split()))
        found.append((label, F.when(F.size("w") > 0, places).otherwise(F.array().cast("array<int>"))))
    d = d.select("doc_id", "th", "n_words", *(f.alias(f"at{i}") for i, (_, f) in enumerate(found)))
    every = F.concat(*(F.col(f"at{i}") for i in range(len(found))))
    base = F.array_compact(F.array(*(F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(found))))
    d = d.select("doc_id", "th", "n_words", every.alias("at"), F.sort_array(F.array_distinct(base)).alias("base"))
    frequency = frequencies(docs, templates)
    own = matches(spark, docs, templates, share, frequency).select("doc_id", "th", "label", "containment", F.lit(1).alias("block"))
    if wrapped:
        own = own.union(spans(spark, docs, templates, share, frequency).withColumn("block", F.lit(0)))
    own = own.groupBy("doc_id", "th", "label").agg(F.max("containment").alias("containment"), F.greatest(F.sum("block"), F.lit(1)).alias("blocks"))
    own = own.groupBy("doc_id", "th").agg(
        F.collect_set("label").alias("own"), F.max("containment").alias("best"), F.sum("blocks").alias("n_blocks")
    )
    own = own.toDF("oid", "oth", "own", "best", "n_blocks")
    j = d.join(own, (d["th"] == own["oth"]) & d["doc_id"].eqNullSafe(own["oid"]), "left")
    labels = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return j.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"), wrapped=True)
