"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "topk_accuracy",
    "distill_samples",
    "distill_loss",
    "batch_samples",
    "rebatch_lists",
    "make_batch_data",
    "balance_batches",
    "fetch_batches",
    "consistent_hash_assign",
    "balance_clients_servers",
    "read_text_records",
    "read_ctr_records",
    "build_vocabulary",
    "vocab_lookup",
    "embedding_lookup_pool",
    "bag_of_words_pool",
    "skip_processed_records",
    "merge_ranges",
    "median",
    "auc_histogram",
    "every_n_steps_mean",
    "lease_liveness",
    "versioned_delta",
    "membership_changed",
    "ngram_samples",
]


def main() -> None:
    from batchloom.plans import QUERIES
    from batchloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": cores})

    def run(name):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("topk_accuracy")  # starts the JVM's and Python's workers
    seconds = {name: round(run(name), 3) for name in sys.argv[1:] or HEADLINE}
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
