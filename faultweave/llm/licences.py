"""Licence scans: rare words of licence texts, looked up by position, and key phrases.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. The
index holds one posting (word, licence, position) per word of each licence text. A file is
held against a licence only if it has all words of that licence's key phrases, without
which it could not be accepted. Of the licence's words that the file has, the twelve that
the fewest documents hold are looked up: each of their places, less the word's place in the
licence, is where the licence would begin. Places that agree within eight words meet in one
of two staggered bands of sixteen; the band with most different words is the match. It counts
if it has at least half of the words that could agree and if every key phrase stands, word
by word, in the words that the match covers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.llm.common import fresh
from faultweave.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Looked-up words of a licence; at most 63, since a mask holds one bit for each.
RARE = 12
#: Words by which places in one band differ at most.
BAND = 16
SHARE = 0.5

#: Phrases and their labels, by which a text names a licence.
NAMED = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class Licence(NamedTuple):
    label: str
    text: str
    phrases: tuple[str, ...]


# The opening or operative words of public licence texts and notices.
LICENCES = (
    Licence(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Licence(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
        " with the license you may obtain a copy of the license at",
        ("licensed under the apache license", "compliance with the license"),
    ),
    Licence("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Licence(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
        ("free software", "gnu general public license"),
    ),
    Licence("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Licence(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
        " general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Licence(
        "agpl",
        "it under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    Licence(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met redistributions of source code must retain the above copyright notice"
        " this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Licence(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Licence(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
        " not distributed with this file you can obtain one at",
        ("mozilla public license",),
    ),
    Licence(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify"
        " publish use compile sell or distribute this software",
        ("unencumbered software released into the public domain",),
    ),
    Licence("cc-by", "licensed under cc by 4 0", ("under cc by 4 0",)),
    Licence("cc-by-sa", "licensed under cc by sa 4 0", ("under cc by sa",)),
    Licence("cc-by-nc", "licensed under cc by nc 4 0", ("under cc by nc",)),
    Licence(
        "cc-by",
        "licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Licence(
        "cc-by-sa",
        "licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    Licence(
        "cc-by-nc",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _stands(words: Column, parts: Sequence[str]) -> Callable[[Column], Column]:
    def stands(i: Column) -> Column:
        return reduce(and_, [F.get(words, i + k) == part for k, part in enumerate(parts)])

    return stands


def _named(words: Column, spaced: Column, named: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The places where the phrases stand and the labels of those that do."""
    places, labels = [], []
    for phrase, label in named:
        parts = phrase.split()
        here = spaced.contains(f" {phrase} ")
        begins = F.sequence(F.lit(0), F.size(words) - len(parts))
        places.append(F.when(here, F.filter(begins, _stands(words, parts))))
        labels.append(F.when(here, F.lit(label)))
    none = F.array().cast("array<int>")
    return (
        F.concat(*[F.coalesce(p, none) for p in places]),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    )


def scan_licences(
    docs: DataFrame,
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    licences: Sequence[Licence] = LICENCES,
    named: Sequence[tuple[str, str]] = NAMED,
) -> tuple[DataFrame, str]:
    """The columns ``carry`` of ``docs`` (all without it) and a struct, whose column name is returned too.

    The struct holds ``n_words``, ``places`` (where the ``named`` phrases begin, in words from
    0), ``base_labels``, ``labels`` (with those of the licence texts found), ``score`` and
    ``matches`` (label, first word, share of the looked-up words that agree). The score is 1
    where a phrase names a licence, else the best share, else 0. A null or empty text has no
    words; equal texts are matched once and repeated rows get equal results; an empty table
    gives no rows. ``licences`` and ``named`` are code: they are all that is broadcast.
    """
    spark = docs.sparkSession
    carry = list(docs.columns if carry is None else carry)
    texts = [x.text.split() for x in licences]
    vocabulary = sorted({w for words in texts for w in words})
    needs = F.array(
        *[
            F.struct(F.lit(i).alias("licence"), _strings(sorted({w for p in x.phrases for w in p.split()})).alias("words"))
            for i, x in enumerate(licences)
        ]
    )
    names = {n: fresh(docs, n) for n in ("words", "spaced", "facts", "licence")}
    words, spaced = F.col(names["words"]), F.col(names["spaced"])
    places, base = _named(words, spaced, named)
    has = F.array_intersect(_strings(vocabulary), words)
    read = docs.select(*[F.col(f"`{c}`") for c in carry], words_of(F.col(f"`{text_col}`")).alias(names["words"]))
    read = read.withColumn(names["spaced"], _spaced(words))
    facts = read.select(
        *[F.col(f"`{c}`") for c in carry],
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            places.alias("places"),
            base.alias("base_labels"),
            has.alias("has"),
            F.md5(spaced).alias("key"),
            words.alias("words"),
        ).alias(names["facts"]),
    )
    fact = names["facts"]
    may = F.transform(
        F.filter(needs, lambda x: F.size(F.array_except(x["words"], F.col(f"{fact}.has"))) == 0), lambda x: x["licence"]
    )
    facts = facts.withColumn(fact, F.col(fact).withField("may", may))
    asked = F.size(f"{fact}.may") > 0
    nothing = F.when(asked, F.col(f"{fact}.words"))
    facts = materialise(facts.withColumn(fact, F.col(fact).withField("words", nothing)), "licence_facts")

    # how many documents hold each word of the licences
    rarity = facts.select(F.explode(f"{fact}.has").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    index = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("licence"),
                        F.lit(x.label).alias("label"),
                        F.lit(len(words)).alias("length"),
                        F.lit(min(RARE, len(set(words)))).alias("n_rare"),
                        _strings(x.phrases).alias("phrases"),
                        _strings(words).alias("text"),
                    )
                    for i, (x, words) in enumerate(zip(licences, texts))
                ]
            )
        )
    )
    postings = index.select("licence", F.posexplode("text").alias("place", "word"))
    ranked = (
        postings.join(rarity, "word")
        .groupBy("licence")
        .agg(F.transform(F.sort_array(F.collect_set(F.struct("n_docs", "word"))), lambda x: x["word"]).alias("rare"))
    )
    known = F.broadcast(materialise(ranked.join(index.drop("text"), "licence"), "licences"))

    # equal texts are looked up once
    files = facts.where(asked).select(f"{fact}.key", f"{fact}.words", f"{fact}.may").dropDuplicates(["key"])
    files = materialise(files, "licence_files")
    looked = (
        files.select("key", "words", F.explode("may").alias("licence"))
        .join(known.select("licence", "rare"), "licence")
        .withColumn("rare", F.slice(F.array_intersect("rare", "words"), 1, RARE))
        .select("key", "licence", "rare", F.posexplode("words").alias("at", "word"))
        .withColumn("bit", F.array_position("rare", F.col("word")) - 1)
        .where("bit >= 0")
    )
    begin = F.col("at") - F.col("place")
    bands = F.array(2 * F.floor(begin / BAND), 2 * F.floor((begin + BAND // 2) / BAND) + 1)
    votes = (
        looked.join(F.broadcast(postings), ["licence", "word"])
        .select("key", "licence", "bit", F.explode(bands).alias("band"))
        .groupBy("key", "licence", "band")
        .agg(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int")))).alias("agree"))
        .groupBy("key", "licence")
        .agg(F.max(F.struct("agree", (-F.col("band")).alias("first"))).alias("best"))
        .select("key", "licence", F.col("best.agree").alias("agree"), (-F.col("best.first")).alias("band"))
    )
    low = F.when(F.col("band") % 2 == 0, F.col("band") / 2 * BAND).otherwise((F.col("band") - 1) / 2 * BAND - BAND // 2)
    first = F.greatest(low.cast("int"), F.lit(0))
    stretch = _spaced(F.slice("words", first + 1, low.cast("int") + BAND + F.col("length") - first))
    matches = (
        votes.join(known, "licence")
        .withColumn("share", F.col("agree") / F.col("n_rare"))
        .where(F.col("share") >= SHARE)
        .join(files.select("key", "words"), "key")
        .withColumn("stretch", stretch)
        .where(F.forall("phrases", lambda p: F.col("stretch").contains(F.concat(F.lit(" "), p, F.lit(" ")))))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("label", first.alias("first_word"), "share"))).alias("matches"))
    )
    matches = materialise(matches, "licence_matches")
    none = F.array().cast(matches.schema["matches"].dataType)
    key, found = names["words"], names["spaced"]
    matches = matches.select(F.col("key").alias(key), F.col("matches").alias(found))
    columns = [F.col(f"`{c}`") for c in carry]
    plain = facts.where(~asked).withColumn(found, none).select(*columns, fact, found)
    named_ = facts.where(asked).withColumn(key, F.col(f"{fact}.key")).join(matches, key, "left")
    named_ = named_.withColumn(found, F.coalesce(found, none)).select(*columns, fact, found)
    labels = F.array_union(f"{fact}.base_labels", F.transform(found, lambda m: m["label"]))
    best = F.array_max(F.transform(found, lambda m: m["share"]))
    result = F.struct(
        F.col(f"{fact}.n_words"),
        F.col(f"{fact}.places"),
        F.col(f"{fact}.base_labels"),
        F.array_sort(labels).alias("labels"),
        F.when(F.size(f"{fact}.base_labels") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.col(found).alias("matches"),
    )
    return plain.unionByName(named_).select(*columns, result.alias(names["licence"])), names["licence"]
