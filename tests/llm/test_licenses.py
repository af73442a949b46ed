from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from quern.llm import licenses as L


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_labels(text):
    """Templates found word for word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return {label for label, notice, _ in L.TEMPLATES if any(w[i : i + len(notice.split())] == notice.split() for i in range(len(w)))}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_own(texts):
    """Labels and best cover of each text by trying every template at every place."""
    n, split, out = len(texts), [words(t) for t in texts], []
    df = {w: sum(w in set(ws) for ws in split) for w in L._vocabulary()}
    idf = {w: 1 + math.log((n + 1) / (c + 1)) for w, c in df.items()}
    for ws in split:
        found = {}
        for label, notice, phrase in L.TEMPLATES:
            x, key = notice.split(), phrase.split()
            first = next(i for i in range(len(x)) if x[i : i + len(key)] == key)
            rare = sorted(set(x) - set(L.COMMON.split()), key=lambda w: (-idf[w], w))[: L.LOOKUPS]
            total = sum(idf[w] for w in x if w in rare)
            for at in range(-len(x), len(ws)):
                if ws[max(0, at + first) : max(0, at + first + len(key))] == key:
                    cover = sum(idf[w] for p, w in enumerate(x) if w in rare and 0 <= at + p < len(ws) and ws[at + p] == w) / total
                    if cover >= L.LEAST_COVER:
                        found[label] = max(found.get(label, 0), cover)
        out.append(found)
    return out


PARTS = ["cc by", "CC-BY", "general public", "license", "General_Public License", "all rights", "reserved", "All Rights\nReserved.", "the", "é", "ccby", "cc", "by by", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "GNU General Public License, version 3", "12", "K", "İ"]


def test_base_against_brute_force(spark):
    random.seed(6)
    docs = [(i, " ".join(random.choice(PARTS) for _ in range(random.randint(0, 14)))) for i in range(400)]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_templates_are_found_in_place(spark):
    noise = "lorem ipsum dolor sit amet " * 30
    docs = [(i, f"{noise} {notice.title()} {noise}") for i, (_, notice, _) in enumerate(L.TEMPLATES)]
    docs += [(1000 + i, " ".join(reversed(notice.split()))) for i, (_, notice, _) in enumerate(L.TEMPLATES)]
    docs += [(2000 + i, noise + str(i)) for i in range(300)]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for i, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in rows[i].labels.split(","), (label, rows[i])
        assert brute_labels(docs[i][1]) <= set(rows[i].labels.split(","))
        assert label not in rows[1000 + i].labels.split(",")  # the words without their order are no notice
    assert all(rows[2000 + i].labels == "" and rows[2000 + i].score == 0 for i in range(300))


def test_key_phrase_is_mandatory(spark):
    rows = L.scan(spark.createDataFrame([(1, "licensed under the apache license version 2 1"), (2, "licensed under the apache license version 2 0")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "", 2: "apache-2.0"}


def test_hard_rows(hard, none):
    rows = L.scan(hard).collect()
    assert sorted(((r.doc_id, *brute(None)[:0], r.n_words) for r in rows), key=str) == sorted(((r.doc_id, brute(r.text)[0]) for r in hard.collect()), key=str)
    assert L.scan(none).count() == 0
    assert L.scan(hard.where("doc_id is null")).count() == 2


def test_a_text_full_of_licence_words(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("general public license " * 20_000).alias("text"))
    r = L.scan(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (60_000, 20_000, 0, 59_997)


def test_no_python_in_the_plan(hard):
    plan = L.scan(hard)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_every_notice_of_a_file_is_found(spark):
    """A file with more licence words than a template has keeps all its notices."""
    notices = {label: notice for label, notice, _ in L.TEMPLATES}
    docs = [(1, " and here ".join(notices.values())), (2, f"{notices['mit']} {notices['apache-2.0']}"), (3, f"{notices['mit']} {notices['gpl-3.0']}")]
    docs += [(100 + i, "lorem ipsum " + (notices["mit"] if i % 3 else "dolor")) for i in range(300)]
    rows = {r.doc_id: set(r.labels.split(",")) for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)).collect()}
    assert set(notices) <= rows[1]
    assert rows[2] == {"mit", "apache-2.0"} and {"mit", "gpl-3.0"} <= rows[3]


def test_labels_against_brute_force(spark):
    """Both ways: notices whole, cut, misspelt, shuffled, and several in a file."""
    rng = random.Random(12)
    texts = [None, "", "K İ licensed under the MIT License"]
    for _ in range(250):
        parts = []
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            x = rng.choice(L.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], ["odd"], [x[at], "more"], [x[at].upper()]])
            parts.append(" ".join(x[rng.choice([0, 0, 2]) :]))
            parts.append(rng.choice(["", "lorem ipsum", "the software, by license:", "public domain"]))
        texts.append(rng.choice([" ", ". ", "\n"]).join(parts))
    wanted = brute_own(texts)
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert sum(map(len, wanted)) > 150
    for i, found in enumerate(wanted):
        base = set(filter(None, brute(texts[i])[4].split(",")))
        assert rows[i].labels == ",".join(sorted(base | set(found))), texts[i]
        assert abs(rows[i].score - max([0.5 if base else 0.0, *found.values()])) < 1e-9


def test_one_file_and_equal_files(spark):
    """A notice in every file, and that of a table's only file, is found as among others."""
    text = "Licensed under the Apache License, Version 2.0"
    for n in (1, 50):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
        assert {r.labels for r in L.scan(df).collect()} == {"apache-2.0"}


def words_in_spark(spark, text):
    return spark.range(1).select(L.words_of(F.lit(text)).alias("w")).first().w


def test_only_ascii_letters_are_lowered(spark):
    assert words("\u0130\u212a A") == ["\u0130\u212a", "a"]
    assert words_in_spark(spark, "\u0130\u212a A") == ["\u0130\u212a", "a"]
