"""Every order of the filters, applied document by document."""

import random
import re
from itertools import permutations

from evidra.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, digest string, copy int, n_words int, left int"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(docs):
    """(part, failing letters, doc_id) of each row."""
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and t in first and first[t] < i,
        }
        yield lang or "", {f for f, x in bad.items() if x}, i


def brute(docs, labels):
    docs = list(fails(docs))
    good, toxic = ({i for i, *x, _ in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for p, _, _ in docs}:
        own, totals = [(f, i) for p, f, i in docs if p == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                totals[f] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(f in x for x, _ in own) - len(lost), sum(x == {f} for x, _ in own), sum(i in good for _, i in lost), sum(i in toxic for _, i in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(totals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(make, docs, labels):
    v = filter_audit.verdicts(filter_audit.measured(make(docs, DOCS)), make(labels, LABELS))
    rows = filter_audit.audit(v).collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_against_brute_force(make):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "ünd Ä ß " * 150, "A" * 50 + " b" * 300, "word " * 250]
    for _ in range(60):
        t = " ".join(rng.choices([f"w{i}" for i in range(rng.choice([20, 400]))], k=rng.choice([150, 199, 200, 260])))
        texts.append(t + rng.choice(["", "", " #", " |", " X" * 30]))
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "p", "d", 1, 2, 3) for i in range(150)]
    docs += [docs[7], (docs[7][0], "another text", "en", *docs[7][3:]), (None, texts[10], "fr", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "x") for i in range(0, 150, 2)] + [(2, 1, 0, "x"), (None, 1, 1, "x")]
    assert audited(make, docs, labels) == brute(docs, labels)


def test_very_long_text_and_ties_of_words(make):
    docs = [(1, "w " * 300_000, "en", "p", "d", 1, 2, 3), (2, " ".join(map(str, range(200))), "en", "p", "d", 1, 2, 3)]
    got = audited(make, docs, [])
    assert got == brute(docs, [])
    assert got["en", "ABCDE", 5][0] == 1


def test_nothing(make):
    assert audited(make, [], [(1, 1, 1, "x")]) == {}


def test_each_unordered_prefix_once(spark, make, tmp_path):
    from evidra.llm.common import Scratch

    v = filter_audit.verdicts(filter_audit.measured(make([(i, "w " * i, "en", "p", "d", 1, 2, 3) for i in range(20)], DOCS)), make([], LABELS))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert len(filter_audit.edges(v, Scratch(spark, "edges"), "ABCDE")) == 31
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
