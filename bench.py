"""Time the headline queries.  Prints one JSON line.

Every query first runs once on a small data set next to the measured one, as a job on large data does not
spend its time on the start of the JVM and on compiling.  Each timed run is the first on its data.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postwatch.catalog import QUERIES  # noqa: E402
from postwatch.session import local_session  # noqa: E402

HEADLINE = [
    "keyword_rollup", "disease_rollup", "hashtag_rollup", "user_rollup", "tumbling_6h_offset",
    "window_count_zero_filled", "term_substring_filter", "term_tagging", "tag_union",
    "hashtag_explode", "keyword_extract", "clean_text", "expand_contractions", "tokenize_ws",
    "json_decode", "raw_replay", "rollup_sink", "geo_enrich", "vocab_fit", "texts_to_sequences",
    "binary_bow", "sentence_to_indices", "sentence_to_matrix", "oov_per_doc", "oov_totals",
    "dim_bridge", "split_positional", "class_weights", "per_class_metrics", "micro_metrics",
    "leaderboard", "cosine_topk", "nb_gaussian_stats", "stream_ingest", "stream_fanout",
    "stream_rollup", "lr_binary", "sweep_leaderboard",
]


def run(spark, name: str, folder: str) -> None:
    """Work out all rows of a query and drop them."""
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    wanted = sys.argv[1:] or HEADLINE
    small = Path(os.environ.get("BENCH_WARMUP_DIR", Path(folder).parent / "sf0.001"))
    for name in wanted if small.is_dir() else []:
        run(spark, name, str(small))
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        run(spark, name, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
