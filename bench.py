"""Run the headline queries and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import tempfile
import time

from turnsift import registry
from turnsift.session import build_session

HEADLINE = [
    "norm_text", "extract_urls_text", "content_hash", "classify_noise", "page_text_extract", "page_link_extract",
    "dedup_window_role", "dedup_first_seen", "stream_prefix_collapse", "user_echo_leading_chars",
    "recent_history_dedup", "repeat_policy", "genuine_response_match", "debounce_last", "replay_dedup",
    "velocity_ext", "velocity_events", "signal_decisions_lab", "model_filters_sonnet", "parse_command", "parse_play",
    "url_repair_audit", "filtered_out", "quality_score", "dup_rate", "phase_summary", "bulk_burst_report",
    "fan_out_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="turnsift-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    spark.read.parquet(f"{folder}/conversations.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
