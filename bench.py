"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vocalgrid.plans import catalog
from vocalgrid.session import local_session

HEADLINE = (
    "geometric_features geometric_means pca_transform mel_features mfcc_features subject_split split_info "
    "pseudo_label_job otsu_threshold multi_otsu tissue_mask vocal_tract_mask class_distribution dice_iou macro_eval "
    "motion_energy_l1 temporal_median spatial_gaussian augment gaussian_smooth interp_asof lag_join audio_envelope align "
    "preprocess_job feature_param_join training_table_job regression_metrics norm_stats standardize corr_distribution "
    "tier_representatives top_n_per_subject ecdf histogram shard_assign pad_collate sequence_chunks manifest_explode "
    "progress_stream"
).split()


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # Session, Python workers and file footers are warmed once, outside the timings.
    catalog.QUERIES["class_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["spatial_gaussian"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
