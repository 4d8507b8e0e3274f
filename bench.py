"""Time the headline queries; prints one JSON line.

Each query is run to completion through Spark's no-op sink (all columns are
computed, nothing is collected). One unmeasured query warms up the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = [
    "scan_expr",
    "filter_cells_min_genes",
    "normalize_total",
    "log1p_expr",
    "hvg_select",
    "hvg_select_batched",
    "export_records",
    "pair_modalities",
    "augment_expression",
    "assign_minibatches",
    "running_mean",
    "topk_per_key",
    "composition_by_sample",
    "marker_dotplot_table",
    "box_stats_by_group",
    "rank_with_ties",
    "ranksum_test_cells",
    "encode_cells",
    "export_attention",
    "knn_topk",
    "knn_label_transfer",
    "hierarchical_label_transfer",
    "knn_graph",
    "silhouette",
    "f1_scores",
    "adjusted_rand",
    "contrastive_loss_report",
    "consistency_loss_report",
    "build_vocab",
    "basic_tokenize",
    "wordpiece_tokenize",
    "candidate_pairs",
    "longest_common_substring_join",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from cytoplane.plans import ORACLES, QUERIES
    from cytoplane.session import clean, get_spark

    spark = get_spark("bench", f"local[{cores}]")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_expr"](spark, folder).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clean(spark)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    if os.environ.get("BENCH_DUCKDB"):
        sys.path.insert(0, str(ROOT / "tests"))
        import oracle

        con = oracle.connect(folder)
        con.execute(f"SET threads = {cores}")
        line["duckdb"] = {}
        for name in names:
            if name in ORACLES:
                start = time.perf_counter()
                con.execute(f"CREATE OR REPLACE TEMP TABLE twin AS {ORACLES[name]}")
                line["duckdb"][name] = round(time.perf_counter() - start, 3)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
