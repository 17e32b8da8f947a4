"""Licence scans by a positional rare-token index, in DataFrame functions only.

Words are runs of 0-9, A-Z (lower-cased), a-z and all non-ASCII characters.  Three things are found in a text:

* base places: where a phrase's words stand one after the other (``PHRASES``);
* the document frequency, over all documents, of every word of the ``TEMPLATES``; each template is indexed by its
  ``RARE`` words of the highest inverse frequency, with their positions (the postings);
* alignments: the places of those rare words in a text, less their positions in a template, agree in one offset where the
  template stands.  An alignment's score is the share of the template's rare weight that it holds; it counts when it
  reaches ``LEAST`` and every key phrase of the template stands at its own position.

Only texts with a word that all key phrases need (``CUE``) are split into positions; the frequencies are counted over all.
The postings have ``RARE`` rows a template, so the join with them is a broadcast of a known size.

Defined results: null text has no words; a text's labels are those of its base phrases and its alignments; rows that
repeat a doc_id, and null ids, are judged each by their own text; of templates that stand, all labels count and the largest
share; a long text is read whole, its words in one array; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RARE = 6
LEAST = 0.6
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every base phrase, and a key phrase of every template, holds one of these.
CUE = rf"(?i)licen[sc]e|copying|copyright|redistribution|public{SEPARATOR}domain|held{SEPARATOR}liable"

PHRASES: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]

    def words(self) -> list[str]:
        return self.text.split(" ")


TEMPLATES: tuple[Template, ...] = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included",
        ("permission is hereby granted free of charge", "the above copyright notice and this permission notice"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("licensed under cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("licensed under cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("licensed under cc by 4 0",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("you may not use this file except in compliance with the license",),
    ),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("provided that the above copyright notice and this permission notice appear in all copies",),
    ),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software",
        ("accompanying documentation covered by this license",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("in no event will the authors be held liable", "permission is granted to anyone to use this software for any purpose"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("under the terms of the gnu general public license as published by the free software foundation",),
    ),
    Template("all-rights-reserved", "copyright all rights reserved", ("copyright all rights reserved",)),
)


def split_words(text: Column) -> Column:
    """The words of a text in order; A-Z lower-cased, other letters as they are."""
    # lower() would also turn some non-ASCII letters into others
    return F.transform(F.filter(F.split(text, SEPARATOR), lambda w: w != ""), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(w))


def word_count(text: Column) -> Column:
    """The number of words; splitting at separators is several times as fast as matching every word."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATOR)
    empty = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return (F.size(parts) - empty).cast("long")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, df) over all of ``docs`` (text); words that are in no document have no row."""
    known = F.array_distinct(F.transform(F.filter(F.split("text", SEPARATOR), lambda w: F.lower(w).isin(vocabulary) & (F.octet_length(w) == F.length(w))), lambda w: F.lower(w)))
    return docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def postings(scratch: Scratch, docs: DataFrame, rare: int = RARE) -> DataFrame:
    """(template, label, word, place, weight, total): each template's rare words, their places and weights."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.words()})
    spark = docs.sparkSession
    places = spark.createDataFrame([(k, t.label, w, p) for k, t in enumerate(TEMPLATES) for p, w in enumerate(t.words())], "template int, label string, word string, place int")
    counted = scratch.save(document_frequencies(docs, vocabulary), "frequencies")
    n = docs.count()
    weighed = places.join(counted, "word", "left").withColumn("weight", F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0)
    distinct = weighed.groupBy("template", "word").agg(F.max("weight").alias("weight"))
    by_rank = distinct.groupBy("template").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "word"))), 1, rare).alias("top"))
    chosen = by_rank.select("template", F.explode("top").alias("t")).select("template", F.col("t.word").alias("word"))
    kept = weighed.join(chosen, ["template", "word"])
    totals = kept.groupBy("template").agg(F.sum("weight").alias("total"))
    return scratch.save(kept.join(totals, "template").select("template", "label", "word", "place", "weight", "total"), "postings")


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the words of ``phrase`` stand from place ``at`` (from 0) on."""
    hit = F.get(words, at) == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        hit = hit & (F.get(words, at + k) == w)
    return F.coalesce(hit & (at >= 0), F.lit(False))


def base_places(words: Column) -> Column:
    """array<struct<place, label, last>> of the base phrases, by place."""
    found = None
    for phrase, label in PHRASES.items():
        own = phrase.split(" ")
        starts = F.filter(F.transform(words, lambda w, i: F.when(w == own[0], i)), lambda i: i.isNotNull())
        if len(own) > 1:
            starts = F.filter(starts, lambda i: _stands(words, i, own))
        hits = F.transform(starts, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))
        found = hits if found is None else F.concat(found, hits)
    return F.sort_array(found)


def scan(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "licenses")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    index = postings(scratch, plain)
    cued = F.coalesce(F.col("text").rlike(CUE), F.lit(False))

    # numbered once and written: the number names the row from here on
    texts = plain.where(cued).select(F.monotonically_increasing_id().alias("row"), "doc_id", split_words(F.col("text")).alias("words"))
    texts = scratch.save(texts.withColumn("base", base_places(F.col("words"))), "texts")
    vocabulary = sorted({w for t in TEMPLATES for w in t.words()})
    places = texts.select("row", F.explode(F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))).alias("x")).select("row", "x.at", "x.word")
    # RARE rows a template
    aligned = places.join(F.broadcast(index), "word").withColumn("offset", F.col("at") - F.col("place"))
    scored = aligned.groupBy("row", "template", "label", "offset").agg(F.sum("weight").alias("held"), F.max("total").alias("total"))
    scored = scored.withColumn("share", F.least(F.col("held") / F.col("total"), F.lit(1.0))).where(F.col("share") >= LEAST)

    whole = F.lit(False)
    for k, t in enumerate(TEMPLATES):
        own, keys = t.words(), F.lit(True)
        for key in t.keys:
            phrase = key.split(" ")
            place = next(p for p in range(len(own)) if own[p : p + len(phrase)] == phrase)
            keys = keys & _stands(F.col("words"), F.col("offset") + place, phrase)
        whole = whole | ((F.col("template") == k) & keys)
    verified = scored.join(texts.select("row", "words"), "row").where(whole)
    methods = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    places_of = F.transform("base", lambda b: b["place"])
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    judged = texts.join(methods, "row", "left").select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places_of).cast("long").alias("first_word"),
        F.array_max(places_of).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )
    none = F.lit(None).cast("long")
    rest = plain.where(~cued).select(
        "doc_id",
        word_count(F.col("text")).alias("n_words"),
        F.lit(0).cast("long").alias("n_base"),
        none.alias("first_word"),
        none.alias("last_word"),
        F.lit("").alias("base_labels"),
        F.lit("").alias("labels"),
        F.lit(0.0).alias("score"),
    )
    return judged.unionByName(rest)
