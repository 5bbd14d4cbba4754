"""Time the headline queries and print one JSON line.

Each query first runs untimed on the smallest tables beside the given ones, so
that the times are of the work and not of starting the JVM and its workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from glosswork.session import local_session

HEADLINE = (
    "span_mask",
    "pack_blocks",
    "mlm_mask",
    "length_batches",
    "kshot",
    "kshot_early_stop",
    "label_index_first_seen",
    "seeded_shuffle",
    "retrieve_topk",
    "retrieval_augment",
    "embed_corpus",
    "dense_layer",
    "macro_f1",
    "spearman",
    "example_reweight",
    "cloze_exact_match",
    "epoch_mean",
    "stream_metric_rollup",
)


def main() -> None:
    from glosswork.catalog.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    smallest = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        for name in names:
            QUERIES[name](spark, smallest).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
