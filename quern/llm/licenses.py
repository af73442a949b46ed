"""License scans with a positional rare-token index, in DataFrame functions alone.

The index holds, for every notice template, its words with their places (common words aside). Each file's licence
words are kept with their places; all of them are looked up in the index, which has each template's words of highest
inverse document frequency and all those of its mandatory key phrase, and each posting votes for (template, file
place - template place). Votes that agree on one relative place intersect the postings by position. A template holds
where enough of its rare words and every word of its key phrase agree.

Document frequencies are counted over all files. Texts are read once and never shuffled; what moves later are the
few licence words. Votes are rows, summed before the shuffle, so a file full of licence words is no problem.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import columns_for, written

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, mandatory key phrase in it.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc0-1.0", "released under cc0 1 0 universal", "cc0 1 0"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2"),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation files"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "held liable for any damages"),
]

#: Words of the templates too common to index.
COMMON = "a all and any are as at be by for from in into is it its made may no nor of on or shall the this to under use used will with without your"

LOOKUPS, LEAST_COVER = 8, 0.6
_WORD = re.compile(r"[0-9a-z]+")


def _vocabulary() -> list[str]:
    common = set(COMMON.split())
    return sorted({w for phrase in BASE for w in phrase.split()} | {w for _, notice, key in TEMPLATES for w in _WORD.findall(notice) if w not in common or w in key.split()})


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case: runs of letters and digits of ASCII and of any other characters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _places(hits: Column, phrase: str) -> Column:
    """First words of the places where the phrase's words, all of the vocabulary, stand consecutively."""
    parts = phrase.split()
    n = F.size(hits)

    def here(j: Column) -> Column:
        tests = [hits[j + k]["w"] == w for k, w in enumerate(parts)] + [hits[j + len(parts) - 1]["i"] - hits[j]["i"] == len(parts) - 1]
        return reduce(lambda a, b: a & b, tests)

    at = F.when(n >= len(parts), F.sequence(F.lit(0), n - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, here), lambda j: hits[j]["i"])


def _key_places(notice: str, phrase: str) -> list[tuple[int, str]]:
    """The words of a template's key phrase with their places in its notice."""
    whole, part = _WORD.findall(notice), phrase.split()
    first = next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)
    return [(first + i, w) for i, w in enumerate(part)]


def _index(idf: dict[str, float]) -> tuple[list[tuple], list[float]]:
    """Postings (word, template, place, weight of a rare word or 0, 1 for the key phrase) and each template's weight."""
    common, postings, total = set(COMMON.split()), [], []
    for t, (_, notice, phrase) in enumerate(TEMPLATES):
        places = list(enumerate(_WORD.findall(notice)))
        rare = sorted({w for _, w in places if w not in common}, key=lambda w: (-idf[w], w))[:LOOKUPS]
        needed = set(_key_places(notice, phrase))
        mine = [(w, t, p, idf[w] if w in rare else 0.0, int((p, w) in needed)) for p, w in places]
        total.append(sum(v for _, _, _, v, _ in mine))
        postings += [x for x in mine if x[3] or x[4]]
    return postings, total


def licence_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row number, word count, and the licence words of each text with their places; written once."""
    vocabulary = _vocabulary()

    def of(ws: Column) -> Column:
        found = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
        return F.struct(F.size(ws).cast("long").alias("n_words"), found.alias("hits"))

    rows = columns_for(docs, k=key, t=text).select(F.col("k").alias("doc_id"), F.transform(F.array(words_of(F.col("t"))), of)[0].alias("x"))
    return written(rows.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "x.n_words", "x.hits"), "licence")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels`` joins the base phrases' labels and those of the templates that hold. ``score`` is the share of the
    best such template's rare words found in place, 0.5 where only a base phrase stands, else 0. Null and empty texts
    have no words; repeated rows are each scanned, null keys kept, an empty table gives no rows, and other columns
    are not looked at.
    """
    table = licence_words(docs, key, text)
    some = table.where(F.size("hits") > 0)
    n = table.count()
    seen = some.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # one row per vocabulary word
    df = {r.w: r.n for r in seen}
    idf = {w: 1 + math.log((n + 1) / (df.get(w, 0) + 1)) for w in _vocabulary()}  # positive, for words of all files as well
    index, total = _index(idf)
    index = some.sparkSession.createDataFrame(index, "w string, t int, p int, v double, k int")  # the templates' words
    looked = some.select("row_no", F.explode("hits").alias("h"))
    votes = looked.select("row_no", "h.i", "h.w").join(F.broadcast(index), "w").select("row_no", "t", (F.col("i") - F.col("p")).alias("at"), "v", "k")
    totals, sizes, names = (F.array(*map(F.lit, x)) for x in (total, [len(phrase.split()) for _, _, phrase in TEMPLATES], [label for label, _, _ in TEMPLATES]))
    agreed = votes.groupBy("row_no", "t", "at").agg(F.sum("v").alias("v"), F.sum("k").alias("k")).where(F.col("k") == sizes[F.col("t")])
    checked = agreed.withColumn("cover", F.least(F.col("v") / totals[F.col("t")], F.lit(1.0))).where(F.col("cover") >= LEAST_COVER)
    held = checked.groupBy("row_no").agg(F.collect_set(names[F.col("t")]).alias("own"), F.max("cover").alias("cover"))  # at most as many as templates
    base = [(label, _places(F.col("hits"), phrase)) for phrase, label in BASE.items()]
    placed = some.select("row_no", "hits", *(p.alias(f"b{i}") for i, (_, p) in enumerate(base))).drop("hits")
    every = F.concat(*(F.col(f"b{i}") for i in range(len(base))))
    labelled = F.array_compact(F.array(*(F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(base))))
    found = placed.select("row_no", every.alias("places"), labelled.alias("base")).join(held, "row_no", "left").where((F.size("places") > 0) | F.col("own").isNotNull())
    empty = F.array().cast("array<string>")
    joined = table.select("row_no", "doc_id", "n_words").join(found, "row_no", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce("base", empty)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", empty), F.coalesce("own", empty))), ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
