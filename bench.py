"""Time the headline queries and print one JSON line.

Every query runs twice to warm up and then three times; the median counts. A run
covers building the query, planning it and computing every row. With ``--extraction`` it
measures the extraction's throughput instead.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

import fixture_queries  # noqa: E402
from pagelake.operators.cards import extract_details, listing_cards  # noqa: E402
from pagelake.plans.rules import DETAILS, LISTING_CARDS  # noqa: E402
from pagelake.session import local_session, stage  # noqa: E402

HEADLINE = (
    "explode_cards",
    "dedup_first",
    "stop_at_gap",
    "award_label",
    "detail_record",
    "enrich_left",
    "top_k_stable",
    "completeness",
    "append_new",
    "slice_tail",
    "page_tallies",
    "last_wins_map",
    "nearby_first_n",
    "csv_flat_roundtrip",
    "build_listing",
    "build_details",
    "directory_listing",
    "directory_details",
)
WARMUPS = 2
RUNS = 3
COPIES = 20


def seconds(spark, sf: str, name: str) -> float:
    started = time.perf_counter()
    fixture_queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def extraction(spark, sf: str, cpus: int) -> dict[str, float]:
    """MB of html a second and core: the scan alone, result pages, detail pages.

    Pages in the directory's markup are written out first, so only reading and
    extracting them is timed.
    """
    pages = {
        "cards": fixture_queries._directory(spark, sf),
        "details": fixture_queries._directory_details(spark, sf).select("url", "html"),
    }
    done = {
        "cards": lambda df: listing_cards(df, LISTING_CARDS),
        "details": lambda df: extract_details(df, DETAILS),
        "scan": lambda df: df.select(F.length("html")),
    }
    out = {}
    for name, df in pages.items():
        # Each page several times, so that planning the query is a small part of the time.
        df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).drop("copy")
        stored = stage(df.repartition(4 * cpus), "bench")
        megabytes = stored.agg(F.sum(F.octet_length("html"))).first()[0] / 1e6
        for what in (name, "scan"):
            runs = []
            for _ in range(RUNS):
                started = time.perf_counter()
                done[what](stored).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - started)
            out[what if what == name else f"scan of {name}"] = round(megabytes / min(runs) / cpus, 2)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    if "--extraction" in sys.argv:
        print(json.dumps({"metric": "MB/s per core", "queries": extraction(spark, sf, int(cpus))}))
        return
    times = {}
    for name in HEADLINE:
        for _ in range(WARMUPS):
            seconds(spark, sf, name)
        times[name] = round(statistics.median(seconds(spark, sf, name) for _ in range(RUNS)), 3)
    result = {
        "metric": "sum of median query seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
