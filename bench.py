"""Headline-query bench: prints ONE JSON line with per-query seconds.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mnemo.plans.catalog import load_all  # noqa: E402
from mnemo.session import get_session  # noqa: E402

HEADLINE = [
    "scores_summary_by_split",
    "sentence_bleu_smooth",
    "corpus_bleu",
    "dedup_exact",
    "contiguous_shards",
    "train_test_split",
    "structure_patterns",
    "min_max_normalize",
    "contributions_residual",
    "smallest_prefix",
    "seq_numbers",
    "best_tokens",
    "greedy_match",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        if name not in reg:
            continue
        t0 = time.time()
        out = reg[name].fn(spark, sf_dir).collect()
        times[name] = round(time.time() - t0, 3)
        rows[name] = len(out)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
