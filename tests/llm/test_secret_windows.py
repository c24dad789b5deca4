"""Entropy windows by class and the allow-list by piece; the digest columns of the query."""

import hashlib

import pytest

from evidra.llm import secret_scan


def entropy(t):
    return [t[s:e] for k, s, e in secret_scan.spans(t) if k == "entropy"]


@pytest.mark.parametrize(
    "t, held",
    [
        ("id_0F3A0C1E3B2D0856AF03C1 x", "0F3A0C1E3B2D0856AF03C1"),
        ("test/callback/key=aB3dE6gH9jK2mN5pQ8sT", "aB3dE6gH9jK2mN5pQ8sT"),
        ("testaB3dE6gH9jK2mN5pQ8sTvW1x", "aB3dE6gH9jK2mN5pQ8sTvW1x"),
        ("k qwhzkxvbnmtrplsdfghjkc", "qwhzkxvbnmtrplsdfghjkc"),
        ("v: kJhGfDsAqWeRtYuIoPzX", "kJhGfDsAqWeRtYuIoPzX"),
    ],
)
def test_found(t, held):
    assert any(held in x for x in entropy(t)), entropy(t)


@pytest.mark.parametrize(
    "t",
    [
        "internationalization-and-localization-of-software",
        "Donaudampfschifffahrtsgesellschaft",
        "0f3a0c1e-3b2d-4856-af03-c1d2e3f40516 and urn/0f3a0c1e-3b2d-4856-af03-c1d2e3f40516",
        "docs/reference/guide/chapter12/section_03/page-0007",
        "2024-01-01/2024-12-31/0123456789",
        "example123_test_sample-placeholder",
        "=" * 60 + "abc" + "-" * 40,
        "a" * 200,
    ],
)
def test_left_alone(t):
    assert entropy(t) == []


def test_query_columns(spark):
    key = "AKIA" + "Z9" * 8
    t = f"é token: {'k3' * 8} {key} {'0a' * 9}"
    df = spark.createDataFrame([("x", t, 1), (None, None, 2), ("x", "", 3)], "doc_id string, text string, spans int")
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans.split(",")[0]) for r in secret_scan.digests(df).collect()}
    base = [("assign", "token: " + "k3" * 8), ("access", key), ("hex", "0a" * 9)]
    told = [f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for k, x in base]
    none = hashlib.sha256(b"").hexdigest()
    assert got == {("x", 1, 1, 1, hashlib.sha256(",".join(told).encode()).hexdigest(), told[0]), (None, 0, 0, 0, none, ""), ("x", 0, 0, 0, none, "")}
