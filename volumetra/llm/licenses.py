"""License scan by diagonal voting [native].

Templates are short word sequences. Every word pair of every text is joined to
the places of that pair in the templates (a fixed table, broadcast: its size is
that of TEMPLATES, whatever the corpus). A match votes for the diagonal
`place in text - place in template`. Votes are bits, one for each place of the
template, so that votes are merged by OR: first on one diagonal, then over the
diagonals within `slack` of it, which lets a few words be added or dropped. A
diagonal whose merged bits cover enough of the template is a verified span.

Base phrases must lie on one diagonal with every bit set, that is, their words
stand consecutively.

Rows are told apart by (doc_id, hash of text). Repeated rows vote for the same
bits, so each gets the same result. Null and empty texts have no words: zero
counts, null places, empty labels, score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.llm.common import whole_text

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Opening statements of public licenses.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("to the extent possible under law the author has waived all copyright", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2


def license_words(text: Column) -> Column:
    """Lower-cased words of digits, a-z and all characters beyond ASCII. (`lower` also folds other letters: that turns
    no character into a separator and, but for U+212A, none into ASCII.)"""
    return F.array_remove(F.split(F.lower(text), NOT_WORD, -1), "")


def template_pairs(spark: SparkSession, templates) -> DataFrame:
    rows = []
    for n, (phrase, label, base) in enumerate(templates):
        w = phrase.split()
        grams = len(w) - K + 1
        if not 1 <= grams <= 63:
            raise ValueError(f"a template has 2 to 64 words: {phrase}")
        rows += [(w[i], w[i + 1], n, label, base, grams, i, 1 << i) for i in range(grams)]
    return spark.createDataFrame(rows, "t0 string, t1 string, template int, label string, base boolean, grams int, place int, bit long")


def spans(docs: DataFrame, key: list[str], words: str, templates, slack: int = 2, coverage: float = 0.8) -> DataFrame:
    """Verified spans: key, template, label, base, diagonal (first word), covered (share of the template)."""
    pairs = F.broadcast(template_pairs(docs.sparkSession, templates).withColumn("gram", F.xxhash64("t0", "t1")))
    grams = docs.select(*key, F.posexplode(F.arrays_zip(F.col(words).alias("a"), F.slice(F.col(words), F.lit(2), F.size(words)).alias("b"))).alias("at", "w"))
    grams = grams.select(*key, "at", F.col("w.a").alias("w0"), F.col("w.b").alias("w1"))
    same = (F.xxhash64("w0", "w1") == F.col("gram")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    votes = grams.join(pairs, same).groupBy(*key, "template", "label", "base", "grams", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = votes.agg(F.bit_or("bit").alias("bits"))
    near = W.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(-slack, slack)
    votes = votes.withColumn("merged", F.when(F.col("base"), F.col("bits")).otherwise(F.bit_or("bits").over(near)))
    covered = F.bit_count("merged") / F.col("grams")
    enough = F.when(F.col("base"), F.lit(1.0)).otherwise(F.when(F.col("grams") < 5, F.lit(1.0)).otherwise(F.lit(coverage)))
    votes = votes.withColumn("covered", covered).filter(F.col("covered") >= enough)
    # Templates that share words also share a span: the best covered one has it. Base phrases are no rivals.
    most = max(len(phrase.split()) for phrase, *_ in templates)
    there = W.partitionBy(*key).orderBy("diagonal").rangeBetween(-most, most)
    rivals = F.collect_list(F.when(~F.col("base"), F.struct("diagonal", "grams", "covered"))).over(there)
    meets = lambda x: (x["diagonal"] <= F.col("diagonal") + F.col("grams")) & (F.col("diagonal") <= x["diagonal"] + x["grams"])
    votes = votes.withColumn("rivals", rivals).withColumn("best", F.array_max(F.transform(F.filter("rivals", meets), lambda x: x["covered"])))
    return votes.filter(F.col("base") | (F.col("covered") == F.col("best"))).drop("best", "rivals")


def scan(docs: DataFrame, templates=TEMPLATES, slack: int = 2, coverage: float = 0.8) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    every = [(p, label, True) for p, label in BASE] + [(p, label, False) for p, label in templates]
    text = whole_text()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), license_words(text).alias("words"))
    found = spans(rows.filter(F.size("words") > 1), ["doc_id", "text_key"], "words", every, slack, coverage)
    base = F.col("base")
    found = found.groupBy("doc_id", "text_key").agg(
        F.count_if(base).alias("n"),
        F.min(F.when(base, F.col("diagonal"))).alias("lo"),
        F.max(F.when(base, F.col("diagonal"))).alias("hi"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("bl"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("al"),
        F.max("covered").alias("best"),
    )
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "n", "lo", "hi", "bl", "al", "best")
    counted = rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    out = counted.join(found, counted.doc_id.eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_base"),
        F.col("lo").cast("long").alias("first_word"),
        F.col("hi").cast("long").alias("last_word"),
        F.coalesce("bl", F.lit("")).alias("base_labels"),
        F.coalesce("al", F.lit("")).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
