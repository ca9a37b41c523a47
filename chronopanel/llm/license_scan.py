"""Finding license texts by diagonal voting.

All rolling word k-grams of a document are hashed and joined to the positions of the same k-grams in license
templates. A match at document position p and template position t votes for the diagonal p - t: a copy of the
template, however long, puts all its votes on one diagonal, and an insertion moves the rest to a neighbouring one.
Votes are added up by diagonal, neighbouring diagonals merged, and the span they cover is verified on the words.

The main path is DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.registry import query, table
from chronopanel.llm.text import BREAK_CLASS, ascii_lower, id_and_text, same, text_key
from chronopanel.session import materialize

# Broadcast bounds: grams of all templates; verified-candidate documents.
MAX_TEMPLATE_GRAMS = 100_000
MAX_BROADCAST_DOCS = 50_000


@dataclass(frozen=True)
class Template:
    """``k`` words to a gram; found where ``coverage`` of its grams vote. ``base`` marks plain phrases."""

    label: str
    text: str
    k: int = 3
    coverage: float = 0.6
    base: bool = False


# The base phrases and their labels.
BASE_PHRASES = (
    Template("mit", "mit license", 2, 1.0, True),
    Template("apache", "apache license", 2, 1.0, True),
    Template("gpl", "general public license", 2, 1.0, True),
)

# Wording of public licenses and of the notices that refer to them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files, to deal in the Software without restriction, including without limitation the "
             "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc-by-nc", "licensed under CC BY-NC", 3, 1.0),
    Template("cc-by-sa", "licensed under CC BY-SA", 3, 1.0),
    Template("cc0", "CC0 1.0 Universal", 2, 1.0),
)


def words(text: Column) -> Column:
    """Words of the lower-cased text: digits, a-z and what is not ASCII."""
    return F.filter(F.split(ascii_lower(text), BREAK_CLASS + "+"), lambda w: w != "")


def _gram(w: Column, i: Column, k: int) -> Column:
    """Hash of the k words from position i (0-based); null where the text ends before."""
    last = F.get(w, i + (k - 1))
    return F.when(last.isNotNull(), F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)]))


def _template_grams(spark, templates: Sequence[Template], ks: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(gram positions, templates): __k, __h, __t (template number), __tp; and __t, __label, __words, __need, __grams, __base."""
    rows = ", ".join("({}, '{}', '{}', {}, {}D, {})".format(
        i, t.label.replace("'", "''"), t.text.replace("\\", " ").replace("'", "''"), t.k, t.coverage, str(t.base).lower()) for i, t in enumerate(templates))
    src = spark.sql(f"SELECT * FROM VALUES {rows} AS t(__t, __label, __text, __tk, __coverage, __base)")
    src = src.withColumn("__words", words(F.col("__text"))).withColumn("__grams", F.size("__words") - F.col("__tk") + 1)
    placed = src.select("__t", "__tk", F.col("__words").alias("__w"), F.posexplode("__words").alias("__tp", "__x"))
    h = F.coalesce(*[F.when(F.col("__tk") == k, _gram(F.col("__w"), F.col("__tp"), k)) for k in ks])
    grams = placed.withColumn("__h", h).filter(F.col("__h").isNotNull()).select("__t", "__tp", "__h")
    need = F.greatest(F.ceil(F.col("__coverage") * F.col("__grams")), F.lit(1))
    return grams, src.select("__t", "__label", "__words", "__grams", need.alias("__need"), "__base", "__tk")


def license_spans(docs: DataFrame, templates: Sequence[Template] = BASE_PHRASES + NOTICES, id_col: str = "doc_id",
                  text_col: str = "text", merge_gap: int = 8) -> DataFrame:
    """Verified spans: __id, __key (of the text), label, base, first, last (words from 0), score.

    A span's score is the share of the template's words that the document's words at the span hold in common. Base
    phrases must stand there word for word.
    """
    spark = docs.sparkSession
    if sum(len(t.text.split()) for t in templates) > MAX_TEMPLATE_GRAMS:
        raise ValueError("too many templates for one scan; scan in parts and union the spans")
    ks = sorted({t.k for t in templates})
    grams, known = _template_grams(spark, templates, ks)
    base = id_and_text(docs, id_col, text_col).filter(F.col("__text").isNotNull()).withColumn("__key", text_key(F.col("__text")))
    w = F.col("__w")
    rolled = base.withColumn("__w", words(F.col("__text"))).select(
        "__id", "__key",
        F.posexplode(F.transform(w, lambda x, i: F.struct(*[_gram(w, i, k).alias(f"h{k}") for k in ks]))).alias("__p", "__g"))
    rolled = rolled.select("__id", "__key", "__p", F.explode(F.array(*[F.col(f"__g.h{k}") for k in ks])).alias("__dh"))
    votes = rolled.join(F.broadcast(grams), F.col("__dh") == F.col("__h")).withColumn("__diag", F.col("__p") - F.col("__tp"))
    # A template of some grams needs its share of votes; a diagonal with a tenth of that is noise.
    diagonals = (
        votes.groupBy("__id", "__key", "__t", "__diag")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__p").alias("lo"), F.max("__p").alias("hi"))
        .join(F.broadcast(known.select("__t", "__need", "__grams", "__base", "__tk")), "__t")
        .filter(F.col("n") >= F.when(F.col("__need") == F.col("__grams"), F.col("__need")).otherwise(F.greatest(F.ceil(F.col("__need") / 10), F.lit(1))))
    )
    order = Window.partitionBy("__id", "__key", "__t").orderBy("__diag")
    exact = F.col("__need") == F.col("__grams")
    apart = exact | F.coalesce(F.col("__diag") - F.lag("__diag").over(order) > merge_gap, F.lit(True))
    candidates = materialize(
        diagonals.withColumn("__new", apart.cast("int")).withColumn("__span", F.sum("__new").over(order))
        .groupBy("__id", "__key", "__t", "__span")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("first"), (F.max("hi") + F.first("__tk") - 1).alias("last"), F.first("__need").alias("__need"))
        .filter(F.col("n") >= F.col("__need"))
        .groupBy(F.col("__id").alias("__i"), F.col("__key").alias("__y"))
        .agg(F.collect_list(F.struct("__t", "first", "last")).alias("__spans"))
    )
    small = candidates.count() <= MAX_BROADCAST_DOCS
    on = same(F.col("__id"), F.col("__i")) & (F.col("__key") == F.col("__y"))
    texts = base.dropDuplicates(["__id", "__key"]) if not small else base
    spans = (
        texts.join(F.broadcast(candidates) if small else candidates, on)
        .withColumn("__w", words(F.col("__text")))
        .select("__id", "__key", "__w", F.explode("__spans").alias("__s"))
        .select("__id", "__key", "__s.*", F.slice("__w", F.col("__s.first") + 1, F.col("__s.last") - F.col("__s.first") + 1).alias("__have"))
        .join(F.broadcast(known), "__t")
    )
    shared = F.size(F.array_intersect("__have", "__words")) / F.size(F.array_distinct("__words"))
    score = F.when(exact, F.when(F.col("__have") == F.col("__words"), 1.0).otherwise(0.0)).otherwise(shared)
    return (
        spans.withColumn("score", score)
        .filter(F.col("score") >= F.when(exact, 1.0).otherwise(F.col("__need") / F.col("__grams")))
        .select("__id", "__key", F.col("__label").alias("label"), F.col("__base").alias("base"), "first", "last", "score")
        .distinct()
    )


def license_scan(docs: DataFrame, templates: Sequence[Template] = BASE_PHRASES + NOTICES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    n_base, first_word and last_word (smallest and largest start) and base_labels are of base phrases; labels
    and spans (label, first, last, score) of all templates. score: the best span's, 0 without one.

    Null and empty texts have no words and no labels. Rows that share an id are scanned one by one; equal rows
    give equal results. A template longer than the text finds nothing. An empty table gives an empty result.
    Columns other than id and text are not read.
    """
    spans = license_spans(docs, templates, id_col, text_col)
    only = lambda c: F.when(F.col("base"), F.col(c))
    per_doc = spans.groupBy(F.col("__id").alias("__i"), F.col("__key").alias("__y")).agg(
        F.count(only("first")).alias("n_base"), F.min(only("first")).cast("bigint").alias("first_word"),
        F.max(only("first")).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(only("label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.array_sort(F.collect_list(F.struct("label", "first", "last", "score"))).alias("spans"),
        F.max("score").alias("score"),
    )
    text = F.coalesce(F.col("__text"), F.lit(""))
    base = id_and_text(docs, id_col, text_col).select(
        "__id", text_key(F.col("__text")).alias("__key"),
        F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint").alias("n_words"))
    on = same(F.col("__id"), F.col("__i")) & (F.col("__key") == F.col("__y"))
    return base.join(per_doc, on, "left").select(
        F.col("__id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), "spans",
        F.coalesce("score", F.lit(0.0)).alias("score"))


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
