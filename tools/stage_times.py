"""Stage durations from a Spark event log folder: python tools/stage_times.py <event log dir>.

Reads plain or zstd-compressed event files (``BENCH_EVENT_LOG_DIR`` of bench.py).
"""

import glob
import io
import json
import os
import sys


def events(path):
    for f in sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) or [path]:
        if f.endswith(".zstd"):
            import zstandard

            with open(f, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                yield from (json.loads(line) for line in text if line.strip())
        else:
            with open(f, encoding="utf-8") as text:
                yield from (json.loads(line) for line in text if line.strip())


def main():
    for e in events(sys.argv[1]):
        if e.get("Event") == "SparkListenerStageCompleted":
            i = e["Stage Info"]
            ms = i.get("Completion Time", 0) - i.get("Submission Time", 0)
            print(f"stage {i['Stage ID']:4d}  tasks {i['Number of Tasks']:4d}  {ms:6d} ms  {i['Stage Name'][:70]}")


if __name__ == "__main__":
    main()
