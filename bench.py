"""Time the headline queries and print one JSON line.

Each query is built and run to the end, its rows thrown away, ``BENCH_RUNS`` times; the best run
counts, so the JVM's warm-up does not.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import fixtures  # noqa: E402
from checks.queries import queries  # noqa: E402
from checks.scratch import scratch_path  # noqa: E402
from fieldtempo.plans import write_report  # noqa: E402
from fieldtempo.session import local_session  # noqa: E402

HEADLINE = (
    "summary_all",
    "summary_all_lineitem",
    "iqr_trim",
    "pace_stats_orders",
    "accuracy_comparison_lineitem",
    "enumerator_daily_counts",
    "split_daily_pace",
    "parse_mixed_formats",
    "bad_dates",
    "pace_by_dow",
    "pace_by_dow_tod",
    "pace_histogram_faceted_lineitem",
    "pace_density_orders",
    "campaign_summary",
    "parse_mixed_date_range",
    "campaign_date_range_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registered = queries()
    spark = local_session(cores, app="bench")
    # Writing the campaign files is no query; it is done, and timed, before.
    start = time.perf_counter()
    fixtures.manifest_csv(spark, sf_dir)
    fixture = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
    # The report is one piece of work, so it is timed as one, in a new folder each time.
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        write_report(fixtures.events_uneven(spark, sf_dir), scratch_path(spark, "bench-report"))
        taken.append(time.perf_counter() - start)
    report = round(min(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "fixtures": {"manifest_csv": fixture},
                "whole_report": report,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
