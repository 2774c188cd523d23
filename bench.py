"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "evaluation_report latest_judgements by_name_map pending_items judge_requests leaderboard sort_rank "
    "export_rows skip_report resolve_first canonicalize strip_tags even_chunks shard_floor take_first mix_groups resume_after "
    "chat_segments edit_segments chain_segments image_sizes frames_middle bpe_encode word_dictionary "
    "pack_samples pack_next_fit segment_offsets rope_positions loss_tokens visible_pairs pack_records training_records "
    "write_shards stream_results"
).split()


def main() -> None:
    from packloom.catalog import QUERIES, Tables
    from packloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # One small run starts the JVM paths and Python workers; it is not timed.
    for name in ("evaluation_report", "pack_next_fit"):
        QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
