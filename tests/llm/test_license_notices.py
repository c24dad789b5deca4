"""Clean and competing license notices: the labels that voting gives them."""

import random

from evidra.llm import license_scan

CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
NOTICES = [
    ("released under the Freedom of Information Act", ""),
    ("released under the MIT license", "mit"),
    ("released under the Apache License, Version 2.0", "apache-2"),
    ("Licensed under the Apache License, Version 1.1", ""),
    (CC.format(""), "cc-by"),
    (CC.format("-NonCommercial"), "cc-by-nc"),
    (CC.format("-ShareAlike"), "cc-by-sa"),
    (CC.format("-NonCommercial-ShareAlike"), ""),
    (CC.format("-NoDerivatives"), ""),
    ("licensed under CC BY-NC-SA 4.0", "cc-by-nc"),  # the base phrase alone
    (GNU.format(""), "gpl"),
    (GNU.format("Lesser "), "lgpl"),
    (GNU.format("Affero "), ""),
    (GNU.format("").replace("free software: you", "free software and you"), "gpl"),
    ("licensed under the GNU General Public License version 3", "gpl-3"),
    ("licensed under the GNU General Public License version 2", ""),
]


def test_notices(spark):
    df = spark.createDataFrame([(i, f"Some words before it {t} and some after", None) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string, x string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(NOTICES)] == NOTICES


def test_each_template_finds_itself(spark):
    df = spark.createDataFrame([(i, f"before {t} after") for i, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert got == {i: label for i, (label, _) in enumerate(license_scan.TEMPLATES)}


BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"


def edited(words, r):
    """A sentence with one word lost and one put in, away from the words that tell licenses apart."""
    w = words.split()
    plain = [i for i, x in enumerate(w) if x not in license_scan.TELLING["bsd"].split() and 3 < i < len(w) - 3]
    lost = r.choice(plain[: len(plain) // 2])
    new = r.choice(plain[len(plain) // 2 :])
    return " ".join([*w[:lost], *w[lost + 1 : new], "really", *w[new:]])


def plain_votes(text, template):
    """Places of the template that meet the text on neighbouring diagonals, at most GAP apart, word by word."""
    t, q = text.split(), template.split()
    k = license_scan.K
    votes = sorted((p - j, p, j) for p in range(len(t) - k + 1) for j in range(len(q) - k + 1) if t[p : p + k] == q[j : j + k])
    runs, last = [], None
    for d, p, j in votes:
        if last is None or d - last > license_scan.GAP:
            runs.append([])
        runs[-1].append((p, j))
        last = d
    return [(len({j + i for _, j in x for i in range(k)}) / len(q), min(p for p, _ in x), max(p for p, _ in x) + k) for x in runs]


def test_lost_and_inserted_words_are_bridged(spark):
    r = random.Random(4)
    rows = []
    for i in range(25):
        before = " ".join(r.choices(["alpha", "beta", "gamma"], k=r.randint(0, 9)))
        rows.append((i, f"{before} {edited(BSD, r)} omega".strip()))
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        (cover, first, end), *more = plain_votes(t, BSD)
        assert not more and cover >= license_scan.COVER
        x = got[i]
        assert (x.labels, x.base_labels) == ("bsd", "")
        assert [(y.first_word, y.end_word, round(y.cover, 9)) for y in x.runs] == [(first, end, round(cover, 9))]
        assert x.score == cover


def test_only_ascii_letters_are_lowered(spark):
    rows = [(1, "Under The MIT License"), (2, "ÜNDER The MIT License"), (3, "MIT \u212aK license")]
    phrases = {"under the mit license": "mit", "Ünder the mit": "upper", "ünder the mit": "lower", "mit \u212ak license": "kelvin", "mit kk license": "plain"}
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=phrases)
    assert {r.doc_id: r.base_labels for r in found.collect()} == {1: "mit", 2: "upper", 3: "kelvin"}


def test_a_text_full_of_notices(spark):
    """20,000 notices in one text, next to runs of other labels: as many votes as hits, and none of them carries the text."""
    n = 20_000
    text = "Released under the MIT License. Words between them. " * n
    docs = spark.createDataFrame([(1, text), (2, text), (3, "Released under the MIT License.")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(docs).drop("runs").collect()}
    assert [(rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word) for i in (1, 2)] == [(8 * n, n, 1, 8 * n - 7)] * 2
    assert rows[1].labels == rows[3].labels == "mit"
    runs = license_scan.scan(docs.where("doc_id = 1")).select("runs").first().runs
    assert len(runs) == 2 * n
