"""Summarise stage times from a Spark event log (no UI needed).

    BENCH_EVENTLOG=1 python bench.py          # prints the event-log folder on stderr
    python tools/stage_times.py <event log file or folder> [top]
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _files(path: str) -> list[str]:
    """Event-log files under ``path`` (rolling logs are folders of ``events_*`` files)."""
    if not os.path.isdir(path):
        return [path]
    out = []
    for d, _sub, names in sorted(os.walk(path)):
        out += [os.path.join(d, n) for n in sorted(names) if not n.startswith(("appstatus", "."))]
    return out


def _open(path: str):
    """Text lines of a plain or zstd-compressed event-log file."""
    if path.endswith(".zstd") or path.endswith(".zst"):
        import io

        import zstandard

        raw = open(path, "rb")
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    return open(path, encoding="utf-8")


def main(argv: list[str]) -> None:
    top = int(argv[1]) if len(argv) > 1 else 15
    stages = {}
    job_of_stage = {}
    tasks = defaultdict(lambda: [0, 0.0, 0])  # count, total ms, max ms
    for f in _files(argv[0]):
        with _open(f) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    for sid in ev.get("Stage IDs", []):
                        job_of_stage[sid] = ev["Job ID"]
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    dur = (info.get("Completion Time", 0) or 0) - (info.get("Submission Time", 0) or 0)
                    stages[info["Stage ID"]] = (dur, info.get("Stage Name", ""), info.get("Number of Tasks", 0))
                elif kind == "SparkListenerTaskEnd":
                    t = ev["Task Info"]
                    ms = t["Finish Time"] - t["Launch Time"]
                    agg = tasks[ev["Stage ID"]]
                    agg[0] += 1
                    agg[1] += ms
                    agg[2] = max(agg[2], ms)
    rows = sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]
    print(f"{'stage':>6} {'job':>5} {'wall ms':>8} {'tasks':>6} {'max task ms':>11}  name")
    for sid, (dur, name, n) in rows:
        print(f"{sid:>6} {job_of_stage.get(sid, -1):>5} {dur:>8} {n:>6} {tasks[sid][2]:>11.0f}  {name[:70]}")


if __name__ == "__main__":
    main(sys.argv[1:])
