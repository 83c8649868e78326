"""python -m catalens estimate FOLDER [--max-depth-1] [--sec-per-call S]: what describing a tree would take, as JSON."""

import argparse
import json
import os

from catalens.functions.text import human_bytes, human_time
from catalens.operators import reports
from catalens.session import local_session
from catalens.sources import scan


def main() -> None:
    parser = argparse.ArgumentParser(prog="catalens", description=__doc__)
    parser.add_argument("command", choices=["estimate"])
    parser.add_argument("folder")
    parser.add_argument("--max-depth-1", action="store_true", help="only the files directly in the folder")
    parser.add_argument("--max-file-bytes", type=int, default=10_000_000_000)
    parser.add_argument("--sec-per-call", type=float)
    args = parser.parse_args()
    spark = local_session(cores="*", memory="2g", name="estimate")
    base = os.path.abspath(args.folder)
    paths, complete = scan.walk(base, traverse=not args.max_depth_1)
    files = scan.stat_scan(spark, "root", base, paths).selectExpr("*", "element_at(split(rel_path, '/'), -1) as file_name")
    rows = [r.asDict() for r in reports.estimate(files, args.max_file_bytes).collect()]
    least, most = (sum(r[k] for r in rows) for k in ("calls_min", "calls_max"))
    out = {"path": base, "complete": complete, "categories": rows, "bytes": human_bytes(sum(r["bytes"] for r in rows)), "calls_min": least, "calls_max": most, "other_extensions": [r.asDict() for r in reports.other_extensions(files).collect()]}
    if args.sec_per_call:
        out |= {"time_min": human_time(least * args.sec_per_call), "time_max": human_time(most * args.sec_per_call)}
    print(json.dumps(out, default=str))
    spark.stop()


if __name__ == "__main__":
    main()
