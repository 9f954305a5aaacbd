"""License scan by diagonal voting, in DataFrame functions only.

Each text becomes its list of words; every rolling ``k``-word gram is hashed. A gram
that a template holds becomes a row with its position and its words, and is joined
with the template's positions of the same hash (and the same words: hits are exact).
A hit votes for the diagonal ``position in text - position in template``; votes are
counted by diagonal, diagonals at most ``gap`` words apart merge into a span, and a
span is verified by the share of the template's grams found in it.

Defined cases: a null text has no words; ids may be null or repeat, each row is a
document of its own; an empty table gives no rows; further columns are ignored;
texts shorter than ``k`` words hold no gram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from credence.llm.common import ascii_lower_for_ascii_words

#: Phrases that name a license wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Customary notices, to be found with gaps; words as they are scanned.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution noncommercial": "cc-by-nc",
    "this work is licensed under a creative commons attribution sharealike": "cc-by-sa",
}

#: Fixed value: everything but digits, a-z and what lies outside ASCII ends a word.
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

K = 3


def words_of(text):
    """The words of a text, lower-cased where they are ASCII."""
    low = ascii_lower_for_ascii_words(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(low, _BREAKS), "")


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """All grams of all templates: t_hash, t_gram, template, t_pos, t_grams, label, exact. A few hundred rows."""
    rows = []
    for n, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words = text.split()
        grams = [words[i : i + k] for i in range(len(words) - k + 1)]
        rows += [(g, n, i, len(grams), label, text in PHRASES) for i, g in enumerate(grams)]
    kinds = ("t_gram", T.ArrayType(T.StringType())), ("template", T.IntegerType()), ("t_pos", T.IntegerType()), ("t_grams", T.IntegerType()), ("label", T.StringType()), ("exact", T.BooleanType())
    df = spark.createDataFrame(rows, T.StructType([T.StructField(*x) for x in kinds]))
    return df.withColumn("t_hash", F.xxhash64(*[F.get("t_gram", F.lit(i)) for i in range(k)]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, gap: int = 2) -> DataFrame:
    """Candidate spans of every text, and one row without a template for texts that have none.

    Columns: row (of the input), the id, n_words, template, label, exact, first (start
    of the span in words), last (start of its last gram), votes, coverage (0 to 1).
    """
    spark = docs.sparkSession
    templates = template_grams(spark, k)
    known = [r[0] for r in templates.select("t_hash").distinct().collect()]  # a few hundred hashes of fixed templates

    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")

    def gram_hash(i):
        return F.xxhash64(*[F.get("words", i + j) for j in range(k)])

    at = F.when(n >= k, F.filter(F.sequence(F.lit(0), n - k), lambda i: gram_hash(i).isin(known)))
    found = F.transform(at, lambda i: F.struct(i.alias("pos"), gram_hash(i).alias("hash"), F.slice("words", i + 1, k).alias("gram")))
    hits = words.select("row", "id", n.cast("long").alias("n_words"), F.explode_outer(found).alias("hit")).select("row", "id", "n_words", "hit.*")
    votes = hits.join(F.broadcast(templates), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    diagonals = votes.groupBy("row", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"),
        F.first("t_grams").alias("t_grams"), F.collect_set("t_pos").alias("held"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("t_pos").alias("votes"),
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(along) <= gap
    apart = F.when(near & ~F.col("exact"), 0).otherwise(1)
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along))
    per_span = merged.groupBy("row", "template", "span").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"),
        F.min("low").alias("first"), F.max("high").alias("last"), F.sum("votes").alias("votes"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("held")))) / F.first("t_grams")).alias("coverage"),
    )
    return per_span.drop("span")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.6, **kw) -> DataFrame:
    """Licenses per document.

    Columns: the id, n_words, n_base (places of phrases), first_word, last_word (their
    smallest and largest start), base_labels, labels (phrases and notices covered by
    at least ``coverage``), score (best coverage of a verified span, 0 without one).
    """
    base = F.col("exact") & (F.col("coverage") == 1)
    verified = base | (~F.col("exact") & (F.col("coverage") >= coverage))
    out = spans(docs, id_col, text_col, **kw).groupBy("row").agg(
        F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(verified, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
