"""Licence scan of whole texts by a positional index of rare words, in Spark expressions only.

Each template is a run of words. Its index entries are the places of its rarest words, by
document frequency over the whole table. A text looks up the places of these words, each
entry says where the template would have to start, and starts that two entries agree on are
candidates. A candidate counts when the template's key phrases stand at their places and at
least half of the template's words do, weighted by rarity.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabscout.llm.common import text_of

#: Separators between words; words are runs of digits, a to z and any character from U+0080 on.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of a template that are indexed.
RARE = 4
#: Index entries that must agree on a start.
AGREE = 2
#: Starts are counted from here, so that a template may begin before its text; templates are shorter.
BEFORE = 1 << 10


@dataclass(frozen=True)
class Template:
    """``words`` stand in a row; those between ``[`` and ``]`` are key phrases, which must be there.

    ``base``: the whole phrase must be there, and its places are counted.
    """

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.replace("[", "").replace("]", "").split()

    @property
    def key(self) -> list[bool]:
        out, inside = [], self.base
        for part in self.text.split():
            inside = inside or part.startswith("[")
            out.append(inside)
            inside = self.base or inside and not part.endswith("]")
        return out


# Phrases whose places are counted, and notices of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "[permission is hereby granted free of charge to any person obtaining a copy of this software] and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "[the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software]"),
    Template("apache-2", "licensed under the apache license version 2 0 the license [you may not use this file except in compliance with the license] you may obtain a copy of the license at"),
    Template("bsd", "[redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are met"),
    Template("isc", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    Template("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    Template("gpl-2", "this work is licensed under the [gnu general public license version 2]"),
    Template("gpl", "this program is free software you can redistribute it and or modify it [under the terms of the gnu general public license] as published by the free software foundation"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it [under the terms of the gnu lesser general public license] as published by the free software foundation"),
    Template("agpl", "you can redistribute it and or modify it [under the terms of the gnu affero general public license] as published by the free software foundation"),
    Template("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the [eclipse public license 2 0]"),
    Template("cc-by", "this work is licensed under a [creative commons attribution 4 0 international license]"),
    Template("cc-by-sa", "this work is licensed under a [creative commons attribution sharealike 4 0 international license]"),
    Template("cc-by-nc", "this work is licensed under a [creative commons attribution noncommercial 4 0 international license]"),
    Template("unlicense", "this is [free and unencumbered software released into the public domain]"),
)


def words_of(text: Column) -> Column:
    """Words of a text in order, A to Z lower-cased."""
    # lower() makes an ASCII letter of one other character, the Kelvin sign; such a word is in no template.
    safe = F.lower(F.replace(text, F.lit("K"), F.lit("ⱪ")))
    return F.array_remove(F.split(safe, BREAKS), "")


def rarities(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Of each template word: 1000 * ln((1 + texts) / (1 + texts that hold it)), rounded down, plus 1.

    What comes to the driver is one row a template word.
    """
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    # "" stands for the text. A plain explode would make Spark infer a filter that splits each text once more.
    held = words.select(F.explode_outer(F.array_append(F.array_intersect("words", known), "")).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = found.get("", 0)
    return {w: math.floor(1000 * math.log((1 + texts) / (1 + found.get(w, 0)))) + 1 for w in vocabulary}


def index_words(template: Template, rarity: dict[str, int]) -> list[str]:
    """The template's rarest words; equally rare ones in order of the alphabet."""
    return sorted(set(template.words), key=lambda w: (-rarity[w], w))[:RARE]


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text", into: str = "licence") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, places, n_base, first_word, last_word, base_labels, labels, score.

    ``places`` lists every template found (label, base, start in words, score), ``n_base`` counts
    the places of the base phrases and ``first_word`` and ``last_word`` are their least and
    largest start (null if none). Labels are distinct, sorted and joined by commas. ``score`` is
    the largest share of a found template's words that stand at their places, weighted by
    rarity: 1 where a whole template is there, 0 where none is found. A null or empty text has
    no words; repeated rows get the same result each; an empty table gives no rows. A column
    that is called ``into`` already is replaced. One text is held whole by its task.
    """
    if any(len(t.words) >= BEFORE or len(set(t.words)) < AGREE for t in templates):
        raise ValueError(f"a template has fewer than {BEFORE} words and at least {AGREE} different ones")
    body = text_of(text)
    rarity = rarities(docs.select(words_of(body).alias("words")), sorted({w for t in templates for w in t.words}))
    count = len(templates)
    entries: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        for word in index_words(template, rarity):
            entries.setdefault(word, []).extend((place, number) for place, w in enumerate(template.words) if w == word)
    # Tables of bounded size, as constants of the plan.
    index = F.from_json(F.lit(json.dumps({word: [(BEFORE - place) * count + number for place, number in at] for word, at in entries.items()})), "map<string,array<bigint>>")
    known = F.from_json(F.lit(json.dumps([{
        "label": t.label, "base": t.base, "total": sum(rarity[w] for w in t.words),
        "parts": [{"i": i, "word": w, "weight": rarity[w], "key": k} for i, (w, k) in enumerate(zip(t.words, t.key))]} for t in templates])),
        "array<struct<label:string,base:boolean,total:bigint,parts:array<struct<i:int,word:string,weight:bigint,key:boolean>>>>")
    words = F.col("__words")
    rare = list(entries)

    # Each step is a column of its own, so that none is computed twice.
    out = docs.select(F.struct(docs.drop(into)["*"]).alias("__row"), words_of(body).alias("__words"))
    places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(rare), i)))
    out = out.withColumn("__at", F.when(F.arrays_overlap(words, F.split(F.lit(" ".join(rare)), " ")), places).otherwise(F.array().cast("array<int>")))
    # A start and a template in one number, once for each entry.
    votes = F.flatten(F.transform("__at", lambda i: F.transform(F.element_at(index, F.get(words, i)), lambda e: e + i.cast("bigint") * count)))
    out = out.withColumn("__votes", F.sort_array(votes))
    held = F.col("__votes")
    agreed = F.array_compact(F.transform(held, lambda v, i: F.when(
        (F.get(held, i + (AGREE - 1)) == v) & F.coalesce(F.get(held, i - 1) != v, F.lit(True)), v)))
    out = out.withColumn("__agreed", agreed)

    def placed(v: Column) -> Column:
        return F.struct(F.element_at(known, (v % count + 1).cast("int")).alias("t"), (F.floor(v / count).cast("int") - BEFORE).alias("start"))

    def weighed(c: Column) -> Column:
        there = lambda p: F.coalesce(F.get(words, c["start"] + p["i"]) == p["word"], F.lit(False))
        sum_ = F.aggregate(c["t"]["parts"], F.lit(0).cast("bigint"), lambda a, p: a + F.when(there(p), p["weight"]).otherwise(F.lit(0).cast("bigint")))
        keys = F.forall(c["t"]["parts"], lambda p: ~p["key"] | there(p))
        return F.struct(c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), c["start"].cast("bigint").alias("start"),
                        (sum_ / c["t"]["total"]).alias("score"), (keys & (2 * sum_ >= c["t"]["total"])).alias("ok"))

    found = F.filter(F.transform(F.transform("__agreed", placed), weighed), lambda p: p["ok"])
    out = out.withColumn("__found", F.transform(found, lambda p: p.dropFields("ok")))
    base = F.filter("__found", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    result = F.struct(
        F.size(words).cast("bigint").alias("n_words"), F.col("__found").alias("places"), F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("__found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("__found", lambda p: p["score"])), F.lit(0.0)).alias("score"))
    return out.select("__row.*", result.alias(into))
