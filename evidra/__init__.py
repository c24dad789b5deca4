"""Evidence-backed company records and training data with Spark."""


def enrich(domains, *, settings=None, output=None, spark=None):
    """See evidra.plans.run.enrich."""
    from evidra.plans import run

    return run.enrich(domains, settings=settings, output=output, spark=spark)
