"""Time the headline queries: one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS``
how often each query is run; the median counts.  Every run goes to completion
into the no-op sink, so nothing is gathered on the driver.
"""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scansio.checks import QUERIES  # noqa: E402
from scansio.session import session  # noqa: E402

HEADLINE = [
    "clean_text", "encode_meter", "dedup_first", "dedup_adjacent", "leak_anti_join", "exact_match",
    "score_table", "by_task", "position_confusion", "split_exact", "split_three_way", "cap_per_group",
    "rebalance", "split_positional", "vocab_rank", "encode_tokens", "vector_coverage", "vector_moments",
    "collate_right", "few_shot_centroid", "src_csv", "sink_splits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    times = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # compile the common operators once, as in a session that has run a query before
    QUERIES["exact_match"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(times):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).lstrip("sf"),
                      "cpus": int(cpus), "runs": times}))


if __name__ == "__main__":
    main()
