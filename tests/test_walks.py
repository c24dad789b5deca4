"""What walks through whole results works a row out once."""

from evidra.sources import runs


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strict_walk(spark):
    """No level serialises what stands below it, and none asks for a schema more than once a value."""
    texts = spark.createDataFrame([(1, '{"schema_version":"1.0","other":{"a":1}}'), (2, "[]"), (3, "no")], "id int, text string")
    found = runs.misfits(texts)
    rows = {(r.id, r["at"], r.rule) for r in found.collect()}
    assert {(1, "run", "unknown"), (1, "run.run_id", "missing"), (2, "run", "kind"), (3, "run", "json")} <= rows
    plan = optimized(found)
    assert "jsonObjectKeys" not in plan and plan.count("schemaOfVariant") == plan.count("explode")
