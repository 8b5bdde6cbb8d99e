"""All registered queries of the library (without the training-data operators) and their SQL."""

from .plans import audit, backtesting, boards, cases, catalog, collected, detection, discovery, landings, markets, paper, people, rounds, rungs, scores, streams, supply  # noqa: F401

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


def flagship(spark, sf_dir):
    return detection.detect_acceleration(spark, sf_dir)
