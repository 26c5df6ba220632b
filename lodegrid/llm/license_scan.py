"""License scans by diagonal voting, in DataFrame functions only.

Every rolling 3-word window of a text is hashed and joined with the windows of the license templates (a
fixed table of a few hundred windows, broadcast). A hit at text word p and template word t votes for
the diagonal p - t, where the template would start. Votes are added up for each text, template and
diagonal; diagonals within ``NEAR`` words of each other (words put in or left out) merge into one span;
a span counts when its words, compared as words and not as hashes, cover enough of the template (of a
span that is too long, the parts of it that do so within the length allowed), and where spans of several templates overlap the words go to the one that is covered best.

Phrases (the base) count only where all their words stand consecutively: a diagonal that has every
window of the phrase. Templates of two words have one window of two words; a text window that begins
with such a pair is joined by the pair's hash, and templates' longer windows that begin with it too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrid.llm.common import table, written

K, NEAR, COVER, STRETCH = 3, 4, 0.85, 1.5
#: Template windows that are sent to all tasks at most; larger tables of templates are joined by exchange.
SENT = 50_000

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Texts of public licenses and of their usual notices, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
]


def words(text: F.Column) -> F.Column:
    """A-Z lower-cased, then runs of digits, letters and all that is not ASCII; null gives none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _windows(w: F.Column) -> F.Column:
    """An array of structs (a, b, c): each word and the two after it (null past the end)."""
    n = F.size(w)
    return F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), n).alias("b"), F.slice(w, F.lit(3), n).alias("c"))


def templates(spark: SparkSession, phrases: dict[str, str], texts: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """The windows of all templates: (key, template, label, base, windows, length, t, ta, tb, tc), and the
    pairs that two-word templates consist of. Its size is that of the fixed tables above."""
    rows = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in texts]
    if any(len(text.split()) < 2 for _, text, _ in rows):
        raise ValueError("templates have two words at least")
    literal = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(t).alias("text"), F.lit(b).alias("base")) for i, (a, t, b) in enumerate(rows)))
    pairs = sorted({text for _, text, _ in rows if len(text.split()) == 2})
    cut = spark.range(1).select(F.inline(literal)).withColumn("w", words(F.col("text"))).withColumn("length", F.size("w"))
    cut = cut.withColumn("windows", F.greatest(F.col("length") - (K - 1), F.lit(1)))
    each = cut.select("template", "label", "base", "length", "windows", F.posexplode(_windows(F.col("w"))).alias("t", "x")).where("t < windows")
    ta, tb, tc = (F.col(f"x.{i}") for i in "abc")
    keyed = each.select(_key(ta, tb, tc, pairs).alias("key"), "template", "label", "base", "windows", "length", "t", ta.alias("ta"), tb.alias("tb"), tc.alias("tc"))
    return keyed, pairs


def _key(a: F.Column, b: F.Column, c: F.Column, pairs: list[str]) -> F.Column:
    short = F.lit(False)
    for p in pairs:
        short = short | ((a == p.split()[0]) & (b == p.split()[1]))
    return F.when(F.coalesce(short, F.lit(False)), F.xxhash64(a, b)).otherwise(F.xxhash64(a, b, c))


def _covering(spans: DataFrame) -> DataFrame:
    """Spans whose windows ``ts`` cover enough of the template's words, with their coverage."""
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (K - 1))))))
    return spans.withColumn("coverage", F.round(covered / F.col("length"), 6)).where(F.col("coverage") >= COVER)


def _parts(spans: DataFrame, key: list[str], longest: int) -> DataFrame:
    """The parts of spans that are too long which cover enough within the length allowed: of those that overlap the
    best covered, then the shortest, then the first."""
    each = spans.select(*key, "cluster", F.inline("at"))
    near = Window.partitionBy("doc_id", "digest", "template", "cluster").orderBy("p").rangeBetween(0, int(STRETCH * longest) - K)
    each = each.withColumn("at", F.collect_list(F.struct("p", "t")).over(near))
    each = each.withColumn("at", F.filter("at", lambda x: x["p"] - F.col("p") + K <= STRETCH * F.col("length")))
    each = _covering(each.withColumn("ts", F.array_distinct(F.transform("at", lambda x: x["t"]))))
    # a part ends where the last of its windows is met for the first time
    firsts = F.transform("ts", lambda t: F.array_min(F.transform(F.filter("at", lambda x: x["t"] == t), lambda x: x["p"])))
    each = each.withColumn("end", F.array_max(firsts) + K)
    one = F.struct((-F.col("coverage")).alias("less"), (F.col("end") - F.col("p")).alias("width"), F.col("p").alias("start"), "end", "ts", "coverage")
    found = each.groupBy(*key, "cluster").agg(F.array_sort(F.collect_list(one)).alias("found"))
    free = lambda some, x: ~F.exists(some, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    picked = F.aggregate("found", F.slice("found", 1, 0), lambda some, x: F.when(free(some, x), F.concat(some, F.array(x))).otherwise(some))
    return found.select(*key, "cluster", F.inline(picked)).drop("less", "width")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, texts: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(results, spans). Results have a row for each row of ``docs``: doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score. Spans: (doc_id, digest, label, template, start,
    end, coverage), start and end in words of the text.

    Null and empty texts have no words and no hits (score 0, null words, empty labels). Rows that repeat
    an id are told apart by a digest of their text, and rows that repeat both share one result, each
    row keeping its own. Null ids are ids. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    grams, pairs = templates(spark, phrases, texts)
    w = F.col("w")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), words(F.col(text_col)).alias("w"))
    # a window with an own key stands for the row itself, so that one pass gives hits and rows
    none = F.lit(None).cast("string")
    mark = F.array(F.struct(F.lit("\x00row").alias("a"), none.alias("b"), none.alias("c")))
    each = rows.select("doc_id", "digest", F.size(w).alias("n"), F.posexplode(F.concat(mark, _windows(w))).alias("at", "x"))
    a, b, c = (F.col(f"x.{i}") for i in "abc")
    each = each.select("doc_id", "digest", "n", (F.col("at") - 1).alias("p"), a.alias("a"), b.alias("b"), c.alias("c"), _key(a, b, c, pairs).alias("key"))
    self_row = grams.limit(0).unionByName(
        spark.range(1).select(F.xxhash64(F.lit("\x00row"), none, none).alias("key"), F.lit(-1).alias("template"), none.alias("label"), F.lit(False).alias("base"), F.lit(0).alias("windows"), F.lit(0).alias("length"), F.lit(0).alias("t"), F.lit("\x00row").alias("ta"), none.alias("tb"), none.alias("tc"))
    )
    same = (F.col("a") == F.col("ta")) & (F.col("tb").isNull() | (F.col("b") == F.col("tb"))) & (F.col("tc").isNull() | (F.col("c") == F.col("tc")))
    table_ = grams.unionByName(self_row)
    if sum(len(t.split()) for t in [*phrases, *(t for _, t in texts)]) <= SENT:
        table_ = F.broadcast(table_)
    found = each.join(table_, "key").where(same)
    found = written(found.select("doc_id", "digest", "n", "p", "template", "label", "base", "windows", "length", "t"), "hits")

    hits = found.where("template >= 0")
    key = ["doc_id", "digest", "template", "label", "base", "windows", "length"]
    votes = hits.withColumn("diagonal", F.col("p") - F.col("t")).groupBy(*key, "diagonal").agg(F.collect_set("t").alias("ts"), F.max("p").alias("last"))
    places = votes.where(F.col("base") & (F.size("ts") == F.col("windows"))).groupBy("doc_id", "digest").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    order = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR) | F.lag("diagonal").over(order).isNull()
    merged = votes.where(~F.col("base")).withColumn("cluster", F.sum(apart.cast("int")).over(order))
    at = F.transform("ts", lambda t: F.struct((F.col("diagonal") + t).alias("p"), t.alias("t")))
    spans = merged.groupBy(*key, "cluster").agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min(F.col("diagonal") + F.array_min("ts")).alias("start"), (F.max("last") + K).alias("end"), F.flatten(F.collect_list(at)).alias("at"))
    spans = _covering(spans)
    fits = F.col("end") - F.col("start") <= STRETCH * F.col("length")
    spans = spans.where(fits).drop("at").unionByName(_parts(spans.where(~fits), key, max(len(text.split()) for _, text in texts) if texts else K))
    # where spans overlap the better covered one takes the words; a span stands if half of its words are its own
    each_word = spans.withColumn("word", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    best = F.max("coverage").over(Window.partitionBy("doc_id", "digest", "word"))
    held = each_word.withColumn("own", (F.col("coverage") == best).cast("int"))
    spans = held.groupBy("doc_id", "digest", "label", "template", "cluster", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "coverage").agg(F.avg("own").alias("own")).where("own >= 0.5").drop("own", "cluster")
    by_text = spans.groupBy("doc_id", "digest").agg(F.collect_set("label").alias("span_set"), F.max("coverage").alias("best"))

    own = found.where("template = -1").select("doc_id", "digest", F.col("n").cast("long").alias("n_words"))
    one = lambda df: df.withColumnsRenamed({"doc_id": "id2", "digest": "digest2"})
    on = (F.col("doc_id").eqNullSafe(F.col("id2"))) & (F.col("digest") == F.col("digest2"))
    joined = own
    for side in (places, by_text):
        joined = joined.join(one(side), on, "left").drop("id2", "digest2")
    empty = F.array().cast("array<string>")
    base, more = F.coalesce("base_set", empty), F.coalesce("span_set", empty)
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.greatest(F.when(F.coalesce("n_base", F.lit(0)) > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    ), spans


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results over ``documents``."""
    return license_scan(table(spark, sf_dir, "documents"))[0]
