"""``python -m siftwright PATH``: scan a folder or a file, print the report, exit with its code."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import project, render, report
from .plans.scan import scan
from .sources import tables


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwright")
    p.add_argument("path")
    p.add_argument("--json", metavar="FOLDER", help="write every section as JSON lines instead of printing")
    p.add_argument("--file", help="only this file (relative path or name)")
    p.add_argument("--axis", help="axes to show, such as A,B")
    p.add_argument("--threshold", help="limits of the axes, such as A:60,B:10")
    p.add_argument("--show", help="sections to show: " + ", ".join(render.SECTIONS))
    p.add_argument("--explain", type=int, metavar="LINE", help="with --file: the finding nearest to a line")
    p.add_argument("--since", metavar="REF", help="only files that differ from this commit")
    p.add_argument("--corpus", metavar="FOLDER", help="folder of the two reference texts")
    return p


def main(argv: list[str] | None = None) -> int:
    args = options().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    files = tables.folder(spark, args.path)
    if args.since:
        changed = tables.changed_paths(spark, args.path, args.since)
        if changed is None:
            print("cannot tell what changed; scanning all files", file=sys.stderr)
        else:
            files = tables.changed(files, changed)
            if files.isEmpty():
                return 0
    result = scan(files, tables.config_documents(spark, args.path), tables.corpus(spark, args.corpus) if args.corpus else None)
    limits = render.limits(args.threshold)
    code = project.exit_code(result.project, tuple(limits[a] for a in "ABC")).first()["exit_code"]
    if args.json:
        report.whole_json(result.sections()).write.mode("overwrite").partitionBy("section").text(args.json)
        return code
    only = render.one_file(result.registry, args.file) if args.file else None
    if args.explain is not None and only is not None:
        asked = only.withColumn("line_number", F.lit(args.explain))
        for r in report.nearest(report.explainable(result.findings, result.review), asked).collect():
            print(f"line {args.explain}: nearest item at distance {r['gap']}: {r['ord']}")
        return code
    if only is None:
        print(render.text_report(result.scores, result.hits, args.path, args.axis, args.threshold, args.show))
    heading = None
    for r in render.detail_lines(result, args.show, only).orderBy("part", "a", "b", "line").toLocalIterator():
        if r["heading"] != heading:
            heading = r["heading"]
            print("", heading, sep="\n")
        print("  " + r["line"])
    return code


if __name__ == "__main__":
    sys.exit(main())
