"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Searches read an index on disk, as a service does; writing it is timed apart, as store_build."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (HERE, os.environ.get("PYTHONPATH"))))  # for Python workers

from attestor import registry  # noqa: E402
from attestor.catalog.store import store_of  # noqa: E402
from attestor.session import session  # noqa: E402

HEADLINE = "tokenize_counts bm25_top5 dense_top10 rrf_hybrid_top5 rrf_pinned_top5 store_filtered_top5 store_own_label_top5 store_figures_top5 store_production routed_gather fixed_chunks section_chunks sentence_claims quote_numbers injection_patterns rates_by_lang token_ledger_60s rate_limit_1h event_fold".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    queries["tokenize_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    began = time.perf_counter()
    store_of(spark, sf_dir)
    times["store_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
