"""Time headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "storm_statistics",
    "precipitation_object_stats",
    "label_components_space_time",
    "breakup_clouds",
    "overlapping_pairs",
    "box_minimum",
    "uniform_smooth_fields",
    "gaussian_smooth_field",
    "gradient_fields",
    "regrid_midpoints",
    "cyclone_objects",
    "object_extent_boxes",
    "tropical_cyclone_tracks",
]


def main() -> None:
    from stormgrid.catalog.queries import QUERIES
    from stormgrid.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    shuffles = 8 if cpus == "*" else max(8, int(cpus))
    spark = local_session(cpus, shuffle_partitions=shuffles, memory="16g")
    # start the JVM's compilers and the Python workers before anything is timed
    QUERIES["slice_components"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
