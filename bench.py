"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import time

from tidemark import registry
from tidemark.session import session

WARM_UP = "category_counts"
HEADLINE = [
    "detect_acceleration", "threshold_falling", "series_features", "driver_health", "gain_share_sweep", "backtest_by_origin", "configuration_grid", "quality_audit", "fdr_survivors", "calibration", "discrimination_auc",
    "scenario_marginals", "store_latest", "store_revisions", "sparklines", "corpus_emergence", "term_signals", "quality_completeness", "pre_consensus", "question_base_rate", "submission_score", "graph_pressure", "ladder_rungs",
    "trade_dependency", "decree_velocity", "locator_cases", "recall_probe_board", "entity_candidates", "experiment_ledger", "stream_daily_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles, starts the threads
    took = {}
    for name in HEADLINE:
        if name in registry.QUERIES:
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
