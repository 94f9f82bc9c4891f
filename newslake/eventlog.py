"""Per-query shuffle and task figures from Spark's event log (no UI, no
REST server): jobs are tagged with a job group per query, and the log is
read back after the session stops."""

from __future__ import annotations

import glob
import json
import os
from collections import defaultdict


def summarize(log_dir: str) -> dict[str, dict[str, float]]:
    """{job group: {shuffle_write_mb, shuffle_read_mb, tasks, task_sec}}."""
    stage_group: dict[int, str] = {}
    out: dict[str, dict[str, float]] = defaultdict(lambda: {"shuffle_write_mb": 0.0, "shuffle_read_mb": 0.0,
                                                            "tasks": 0, "task_sec": 0.0})
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p))
    for path in paths:
        if path.endswith((".zstd", ".lz4", ".snappy", ".lzf")) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as f:
            for line in f:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    if not group:
                        continue
                    m = ev.get("Task Metrics") or {}
                    w = (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    r = m.get("Shuffle Read Metrics") or {}
                    rb = r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                    info = ev.get("Task Info") or {}
                    dur = (info.get("Finish Time", 0) - info.get("Launch Time", 0)) / 1000.0
                    s = out[group]
                    s["shuffle_write_mb"] += w / 1e6
                    s["shuffle_read_mb"] += rb / 1e6
                    s["tasks"] += 1
                    s["task_sec"] += dur
    return {g: {k: round(v, 3) if isinstance(v, float) else v for k, v in s.items()} for g, s in out.items()}
