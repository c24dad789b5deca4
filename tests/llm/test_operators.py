"""The operators against brute force, and the edge cases that each docstring names."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from evidra.llm import license_scan, near_dup, packing, quality, secret_scan, token_counts, vector_near_dup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, hash string, node long"
R = random.Random(5)
VOCAB = [f"w{i}" for i in range(500)]


def text(n):
    return " ".join(R.choices(VOCAB, k=n))


def edited(t, n):
    w = t.split()
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(VOCAB)
    return " ".join(w)


def corpus():
    base = text(200)
    out = [text(R.randrange(60, 200)) for _ in range(40)]
    out += [base, base, base.upper()] + [edited(base, k) for k in (1, 2, 3, 4, 5, 6, 8, 12, 20, 30)]
    out += [None, "", " \n\t", "one", "one", "one two three", "a b c d e", "x " * 3000]
    out += ["Released under the MIT License. " + text(60), "apache  license, version-2! " + text(60) + " CC BY NC", "K under the mit license ünder"]
    out += ["api_key = 'abcdEFGH1234wxyz5678' and AKIA" + "A1B2" * 4 + " " + "0f" * 12 + " é " + "aB3dE6gH9jK2mN5pQ8sT", text(100) + "\n" + "same line\n" * 4]
    rows = [(i, t, "en", R.choice(["a", "b", None]), len(t or ""), "x", "y", 1) for i, t in enumerate(out)]
    return [*rows, (None, text(60), None, None, None, None, None, None), rows[0]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_license_scan(docs, rows, nothing):
    got = by_id(license_scan.scan(docs))
    assert license_scan.scan(docs).count() == len(rows)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert license_scan.scan(nothing).collect() == []


def test_quality(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality(docs, labels))
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(twice)), i
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.score >= r.threshold)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(x.kept for x in quality.quality(docs, labels).collect())
    assert quality.quality(nothing, labels.limit(0)).collect() == []


def sets_of(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, rows, nothing):
    got = by_id(near_dup.near_duplicates(docs))
    sets = {i: sets_of(t) for i, t, *_ in rows if i is not None}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root(i), root(i) == i), i
    assert (got[None].component_id, got[None].kept) == (None, True)
    kept = near_dup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in sets if root(i) == i)
    assert near_dup.near_duplicates(nothing).collect() == []


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 7, 300):
        s = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        assert (near_dup.sketch(s) >> np.uint64(57) == np.arange(near_dup.T)).all()


def test_secret_scan(docs, rows, nothing):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t, *_ in rows:
        base = [("assign", m.start(), m.end()) for m in pattern.finditer(t or "") if len(m[2]) >= 12]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        assert sorted(x for x in secret_scan.spans(t) if x[0] != "entropy") == sorted(base), i
    for s in ("aB3dE6gH9jK2mN5pQ8sT" * 2, "aaaaaaaaaaaaaaaaaaaaaaaab1", "0123456789abcdef01234567", "id_0F3A0C1E3B2D0856AF03C1", "x" * 30 + "/" + "0a1B" * 9):
        inside = set()
        for k in range(len(s) - 19):
            w = s[k : k + 20]
            limit = 3.2 if re.fullmatch("[0-9a-fA-F]+", w) else 3.7 if w.isalnum() else 3.9
            if -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) >= limit - 1e-9:
                inside |= set(range(k, k + 20))
        assert {p for a, b in secret_scan.high_windows(s) for p in range(a, b)} == inside
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert all(not secret_scan.spans(r.text) and r.n_chars == (None if r.doc_id is None else len(r.text or "")) for r in out.collect())
    assert secret_scan.scan(nothing).collect() == []


def test_token_counts(docs, rows, nothing):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = by_id(token_counts.counts(docs, path))
    for i, x, *_ in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((x or "").encode()), n, n > 512)
    c = token_counts.Counter(path)
    odd = ["a" * 999, "<|endoftext|> x<|endoftext|>", "\U00018eb3's\U00018eb3", "  \n\n x ", "l'été 123"]
    assert c.count(odd) == [len(e.ids) for e in t.encode_batch(odd, add_special_tokens=False)]
    assert token_counts.counts(nothing, path).collect() == []


def test_packing(docs, rows, nothing):
    bins = packing.pack(docs, (16, 64, 128)).collect()
    held = {}
    for b in bins:
        assert b.used == sum(b.lengths) <= b.capacity
        assert b.capacity == min(c for c in (16, 64, 128) if c >= b.used)
        for i, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            held.setdefault(i, []).append((s, n))
    for i, t, *_ in rows[1:-2]:
        pieces, at = sorted(held[i]), 0
        for s, n in pieces:
            assert s == at
            at += n
        assert at == len((t or "").split())
    assert packing.pack(nothing).collect() == []


def test_vectors(spark):
    r = np.random.default_rng(2)
    v = [r.standard_normal(32) for _ in range(300)]
    v += [x + r.standard_normal(32) * s for x in v[:150] for s in (0.02, 0.2)] + [v[0]] * 5
    rows = [(i, x.tolist(), int(i % 3 == 0), "x") for i, x in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 1, "x"), (n + 1, [0.0] * 32, 1, "x"), (n + 2, [float("nan")] * 32, 1, "x"), (n + 3, [1.0], 1, "x"), (n + 4, v[0].tolist(), None, "x"), (None, v[0].tolist(), 0, "x"), (n + 5, [None] * 32, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = {x.vec_id: x for x in vector_near_dup.near_duplicates(df).collect()}
    unit = np.stack([x / np.linalg.norm(x) for x in v])
    label = np.array([x[2] for x in rows[:n]])
    want = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(n, dtype=bool)
    found = sum(got[i].n_links for i in range(n))
    assert found <= want.sum() and found >= 0.97 * want.sum()
    assert all(got[i].n_links <= want[i].sum() for i in range(n))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 6))
    assert vector_near_dup.near_duplicates(df.limit(0)).collect() == []


def test_warc(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/", big), (2, "http://b/", big), (5, None, big + "x"), (7, "u", None), (9, "u v", "short"), (10, "u", "short"), (None, "u", big), (2, "http://b/", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    out = [f"file://{tmp_path}/{k}" for k in "ab"]
    manifests = [warc.write(x, o, roll=400, shard=1500) for x, o in zip((df, df.repartition(5)), out, strict=True)]
    got = sorted((tuple(x)[:7] for x in warc.read(manifests[0], out[0]).collect()), key=str)
    want = []
    for i, u, h in pages:
        raw = (h or "").encode()
        again = i == 1
        want.append((i, " ".join((u or "").split()), None if again else raw, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert [sorted((r.name, r.sha256) for r in m.collect()) for m in manifests][0] == sorted((r.name, r.sha256) for r in manifests[1].collect())
    assert len(manifests[0].collect()) > 1 and (tmp_path / "a" / "COMMITTED").exists()
    empty = warc.write(df.limit(0), f"file://{tmp_path}/c")
    assert warc.read(empty, f"file://{tmp_path}/c").collect() == []
