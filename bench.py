"""Time the headline queries at one scale and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quaver.queries import QUERIES  # noqa: E402
from quaver.session import local_session  # noqa: E402

TABLES = "documents embeddings pages labels conversations events".split()

HEADLINE = (
    "clean_row lexical_features junk_classes mojibake_repair mojibake_scan char_ids topk_vocab tfidf "
    "dedupe_first value_counts annotator_agg stratified_split positional_split batch_id seeded_shuffle "
    "token_noise noise_levels char_noise noisy_test augment_train pair_anchor pair_inner phi phi_by_level "
    "jaro_winkler thread_context overlap_weights hierarchical_rows macro_f1 batch_f1 majority_vote "
    "results_pivot seed_stats dist_align spearman kendall vec_cosine ctx_embedding ctx_embedding_weighted mean_pool alignment "
    "soundex_features split_stats pair_clean_only pair_stats phi_histogram disagreement svm lr model_grid"
).split()


def main(names: list[str]) -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    with tempfile.TemporaryDirectory(prefix="quaver-bench-") as folder:
        report(spark, names, source, spread(spark, source, folder))
    spark.stop()


def spread(spark, source: str, folder: str) -> str:
    """Copy the tables to as many files as there are cores, as a cluster would have them: a small file is one task."""
    for table in TABLES:
        rows = spark.read.parquet(f"{source}/{table}.parquet")
        rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/{table}.parquet")
    return folder


def report(spark, names: list[str], source: str, folder: str) -> None:
    seconds = {}
    for name in names or HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(source.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
