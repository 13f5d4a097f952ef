"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# One or more queries of every part of the inventory.
HEADLINE = ["A03", "L03", "G02", "G07", "G08", "G15", "R03", "R10", "R12", "D01", "D03", "E02", "E10", "X01", "X05",
            "J04", "J07", "T03", "T08", "T15", "M05", "S01", "S05", "S19", "W01"]


def main() -> None:
    from cadenza.core.session import get_session
    from cadenza.plans import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    # Derived input tables (catalogue, scores, samples, beats) are shared by many queries, so they have a line of their own.
    from cadenza.plans import canonical as C

    times: dict[str, float] = {}
    start = time.perf_counter()
    for build in (C.tracks, C.vocab, C.scores_a, C.sample_rows, C.beats):
        build(spark, sf_dir)
    times["tables"] = round(time.perf_counter() - start, 3)
    for key in HEADLINE:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
