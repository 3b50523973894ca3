"""License scans by diagonal voting.

Every run of ``K`` words of every document is hashed and joined to the hashes of the license templates. A match of
document position p with template position t votes for the diagonal p - t. Inserted or dropped words shift the rest of a
text to another diagonal, so each voted diagonal is taken together with those up to ``MAX_STRETCH`` - 1 template
sizes above it. The document's words are then compared with the template along these diagonals: a span counts when
at least ``LEAST_COVER`` of the template's words are met and it is at most ``MAX_STRETCH`` times as long, so a changed
word costs one word and text inserted at one place none. Of overlapping spans of a template the best
stays, and a span inside a longer one of another label stays if it meets more words there. A text whose edits leave no run of ``K`` words gets no vote. Base labels are exact phrases.

Words are runs of characters that are neither ASCII symbols nor space, with A-Z lower-cased. Null text has no words.
Rows are known by doc id and text digest, so repeated rows get the same result each; a null doc id is a value like
any other. Other columns play no part. Texts of any length are searched whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import checked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, LEAST_COVER, MAX_STRETCH = 4, 0.8, 1.5
# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Opening sentences and notices of public licenses, as (label, text).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]
# Template runs up to this many are sent to all executors; more are joined by hash.
BROADCAST_RUNS = 100_000


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1))


def phrase_places(words: Column, phrase: str) -> Column:
    """Word positions where the phrase starts."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        fits = F.get(words, i) == parts[0]
        for n, p in enumerate(parts[1:], 1):
            fits = fits & (F.get(words, i + n) == p)
        return fits

    return F.when((last >= 0) & F.array_contains(words, parts[-1]), F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def run_hashes(words: Column, k: int) -> Column:
    """A hash per run of k words, in order."""
    last = F.size(words) - k
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + n) for n in range(k)]))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<bigint>"))


def template_words(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """template, label, wording: the templates of k words or more."""
    cut = [(n, label, re.findall(WORD, text.lower())) for n, (label, text) in enumerate(templates)]
    rows = spark.createDataFrame([r for r in cut if len(r[2]) >= k], "template int, label string, wording array<string>")
    return F.broadcast(rows) if sum(len(r[2]) for r in cut) <= BROADCAST_RUNS else rows


def template_runs(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """template, size (words), at, hash: one row per run of k words of each template."""
    rows = template_words(spark, templates, k)
    runs = rows.select("template", F.size("wording").alias("size"), F.posexplode(run_hashes(F.col("wording"), k)).alias("at", "hash"))
    return F.broadcast(runs) if sum(len(text.split()) for _, text in templates) <= BROADCAST_RUNS else runs


def voted_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, digest, template, label, first_word, last_word, cover: verified license spans. The cover is the number of
    template words met over the words of the template or the span, whichever are more."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words"))
    runs = rows.select("doc_id", "digest", F.posexplode(run_hashes(F.col("words"), k)).alias("pos", "hash"))
    votes = runs.join(template_runs(docs.sparkSession, templates, k), "hash")
    key = ["doc_id", "digest", "template"]
    diagonal = (
        votes.select(*key, "size", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
        .groupBy(*key, "size", "diagonal")
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    # Diagonals in units of the room a template has, so that one range fits all sizes.
    room = F.greatest(F.lit(1.0), F.floor((MAX_STRETCH - 1) * F.col("size")).cast("double"))
    above = Window.partitionBy(*key).orderBy("unit").rangeBetween(0, 1)
    windows = diagonal.withColumn("unit", F.col("diagonal") / room).select(
        *key,
        F.collect_list("diagonal").over(above).alias("diagonals"),
        F.min("low").over(above).alias("first_word"),
        (F.max("high").over(above) + k - 1).alias("last_word"),
    )
    voted = windows.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("template", "diagonals", "first_word", "last_word")).alias("windows"))
    slim, side = checked(voted, "votes")
    right = side(slim.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"}))
    back = rows.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    one = back.select("doc_id", "digest", "words", F.explode("windows").alias("w")).select("doc_id", "digest", "words", "w.*")
    one = one.join(template_words(docs.sparkSession, templates, k), "template")

    def met(t: Column) -> Column:
        """Document words that meet template word t: one along the first diagonal that has it."""
        here = F.filter("diagonals", lambda d: F.coalesce(F.get("words", t + d) == F.get("wording", t), F.lit(False)))
        return F.transform(F.slice(here, 1, 1), lambda d: t + d)

    size, length = F.size("wording"), F.col("last_word") - F.col("first_word") + 1
    places = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), met))
    found = one.select(*key, "label", "first_word", "last_word", size.alias("size"), length.alias("length"), places.alias("places"))
    found = found.where((F.size("places") >= LEAST_COVER * F.col("size")) & (F.col("length") <= MAX_STRETCH * F.col("size"))).distinct()
    # Of a template's windows that overlap one stays: the best, then the first.
    order = Window.partitionBy(*key).orderBy("first_word", "last_word")
    before = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("apart", F.when(F.col("first_word") <= before, 0).otherwise(1)).withColumn("span", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cover = F.size("places") / F.greatest("size", "length")
    best = apart.groupBy(*key, "label", "span").agg(F.max(F.struct(cover.alias("cover"), (-F.col("first_word")).alias("minus"), "last_word", "places")).alias("b"))
    span = F.struct("template", "label", (-F.col("b.minus")).alias("first_word"), F.col("b.last_word").alias("last_word"), F.col("b.cover").alias("cover"), F.col("b.places").alias("places"))
    each = best.groupBy("doc_id", "digest").agg(F.collect_list(span).alias("spans"))

    def explained(x: Column) -> Column:
        """Whether a longer span of another label around x meets as many of its words: GPL notices hold most words of the LGPL's."""
        return F.exists(
            "spans",
            lambda o: (o["label"] != x["label"])
            & (o["first_word"] <= x["first_word"])
            & (o["last_word"] >= x["last_word"])
            & (o["last_word"] - o["first_word"] > x["last_word"] - x["first_word"])
            & (F.size(F.filter(o["places"], lambda p: p.between(x["first_word"], x["last_word"]))) >= F.size(x["places"])),
        )

    kept = each.select("doc_id", "digest", F.explode(F.filter("spans", lambda x: ~explained(x))).alias("x"))
    return kept.select("doc_id", "digest", *[F.col(f"x.{c}").alias(c) for c in ("template", "label", "first_word", "last_word", "cover")])


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word (of the base phrases), base_labels, labels
    (with the voted ones), score (best cover of a template, 0 without a span)."""
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words"))
    places = [phrase_places(F.col("words"), p) for p in PHRASES]
    base = rows.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), *[p.alias(f"p{n}") for n, p in enumerate(places)])
    columns = [F.col(f"p{n}") for n in range(len(places))]
    every = F.concat(*columns)
    labels = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(columns, PHRASES.values())]), lambda x: x.isNotNull())
    base = base.select(
        "doc_id",
        "digest",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("found"),
    )
    voted = voted_spans(docs, templates).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("voted"), F.max("cover").alias("score"))
    same = (base["doc_id"].eqNullSafe(voted["doc_id"])) & (base["digest"] == voted["digest"])
    joined = base.join(voted, same, "left").select(base["*"], "voted", "score")

    def as_text(c: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(c)), ",")

    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        as_text(F.col("found")).alias("base_labels"),
        as_text(F.concat("found", F.coalesce("voted", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
