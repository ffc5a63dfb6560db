"""Time the headline queries and print one JSON line.

Results go to Spark's no-op sink: everything is computed, nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

# a forked launcher and a multi-threaded BLAS in one process can deadlock
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

HEADLINE = [
    "e1_region_balance",
    "e1_small_response_cells",
    "w4_pair_dedup",
    "w7_nearest_to_median",
    "w1_min_max_scale",
    "j3_many_to_many_filter",
    "j4_control_drug_pairs",
    "j5_heading_before_line",
    "f4_stim_descriptors",
    "f12_recording_starts",
    "a1_grouped_mean_null_keys",
    "a12_kernel_density",
    "a13_box_stats",
    "e2_enhancement_normal",
    "t4_rank_sum",
    "t6_pairwise_signed_rank",
    "t12_benjamini_hochberg",
    "t14_gamma_glm_region_position",
    "t16_mixed_model_crossed",
    "i2_tile_coverage",
    "i8_tile_metrics",
    "i12_circle_sampling",
    "i18_warp",
    "i20_largest_component",
    "i22_mask_outline",
    "t20_permutation_test",
    "t21_pooled_permutation_test",
    "w15_second_peak_after_trough",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from axonframe.session import get_spark
    from suite import load_all

    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    registry["a8_distinct"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
