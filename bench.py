"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

from __future__ import annotations

import json
import os
import time

from lumigrid.queries import QUERIES
from lumigrid.session import session

NAMES = [
    "integral_image", "haar_feature_values", "stump_best_feature", "adaboost_rounds", "cascade_predict", "nms_vote_merge", "nms_scored", "group_rectangles",
    "box_iou", "detect_frames", "keypoint_parse", "grouped_text_parse", "seeded_split", "frame_decimation", "rate_window",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "bench", spark__driver__memory="12g", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rate_window"](spark, sf_dir).count()  # starts workers and compiles
    seconds = {}
    for name in NAMES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
