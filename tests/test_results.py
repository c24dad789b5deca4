"""What results take to make: texts stored once, and read for what needs them alone."""

import pytest

from evidra.operators import scoring
from evidra.plans import fixtures
from evidra.sources.commits import Commits

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    """The results, and the tables stored on the way that hold texts."""
    stored, step = [], Commits.step
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Commits, "step", lambda self, name, df: stored.append((name, df.columns)) or step(self, name, df))
        out = fixtures.enriched(spark, DATA)
    return out, [name for name, columns in stored if "text" in columns]


def test_texts_are_stored_once(made):
    assert made[1] == ["found"]


def test_scores_and_states_without_the_list_of_sources(made):
    """The list holds all texts of a domain."""
    plan = lambda *columns: made[0].select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    assert " AS sources#" in plan("sources")
    for columns in (["confidence_score", "confidence_breakdown"], ["ord", "status"], ["crawl", "contact_points", "team_members", "errors", "usage"]):
        assert " AS sources#" not in plan(*columns)


def test_scores_agree_with_the_list_of_sources(made):
    told = lambda df: sorted((r.ord, r.confidence_score, r.confidence_breakdown) for r in df.select("ord", "confidence_score", "confidence_breakdown").collect())
    assert told(made[0]) == told(scoring.factors(made[0]))
