"""Text report: options; a summary put together on the driver from one row a category and frames that are already limited; and the
details of every section as a frame of lines, which may be as long as the scan and never comes to the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from . import classify, project, report

LIMITS = {"A": 50, "B": 25, "C": 100}
SECTIONS = ("hits", "secrets", "review", "exposure", "breakdown")


def axis_filter(text: str | None) -> set[str] | None:
    """``A,b`` to ``{"A", "B"}``; what is no axis is ignored, and nothing left means no filter."""
    wanted = {part.strip().upper() for part in (text or "").split(",")} & set(LIMITS)
    return wanted or None


def limits(text: str | None) -> dict[str, int]:
    """``A:60,b:10`` over the default limits; unreadable parts are ignored."""
    out = dict(LIMITS)
    for part in (text or "").split(","):
        axis, colon, number = part.partition(":")
        digits = number.strip()
        if colon and axis.strip().upper() in out and digits.lstrip("+-").isdigit():
            out[axis.strip().upper()] = int(digits)
    return out


def section_filter(text: str | None) -> set[str] | None:
    wanted = {part.strip() for part in (text or "").lower().split(",")} & set(SECTIONS)
    return wanted or None


def shown(section: str, wanted: set[str] | None) -> bool:
    return wanted is None or section in wanted


def bar(score: float, width: int = 20) -> str:
    filled = min(width, max(0, int(score / 100 * width + 0.5)))
    return "─" * filled + "░" * (width - filled)


def text_report(scores: DataFrame, hits: DataFrame, title: str = ".", axis: str | None = None, threshold: str | None = None, show: str | None = None) -> str:
    """Header, axis table, exit line, worst files, security concerns and breakdown."""
    bounds = limits(threshold)
    whole = project.exit_code(project.project_axes(scores), tuple(bounds[a] for a in "ABC")).withColumns({f"v_{a}": classify.verdict_label(classify.verdict(F.col(f"axis_{a}"))) for a in "abc"}).first()
    lines = [f"{title}  ·  {whole['file_count']:,} files  ·  {whole['total_lines']:,} lines", ""]
    for a in "ABC":
        if axis_filter(axis) is None or a in axis_filter(axis):
            score = whole[f"axis_{a.lower()}"]
            lines.append(f"{a}  {bar(score)}  {score:5.1f}  {whole[f'v_{a.lower()}']}")
    lines += ["", f"exit {whole['exit_code']}  (limits " + ", ".join(f"{a} {n}" for a, n in bounds.items()) + ")"]
    worst, concerns = report.top_offenders(scores).collect(), report.security_concerns(scores).collect()
    for heading, rows, column in (("Top offenders", worst, "max_axis"), ("Security concerns", concerns, "axis_b")):
        if rows:
            lines += ["", heading, *[f"  {r[column]:5.1f}  {r['rel_path']}" for r in rows]]
    if shown("breakdown", section_filter(show)):
        lines += ["", "Breakdown", *[f"  {r['hit_count']:>8,}  {r['file_count']:>6,} files  {r['category']}" for r in report.breakdown(hits).collect()]]
    return "\n".join(lines)


def one_file(files: DataFrame, wanted: str) -> DataFrame:
    """``file_id`` of the first file (by path) with this relative path or name."""
    named = files.where((F.col("rel_path") == wanted) | (classify.basename(F.col("rel_path")) == wanted))
    return named.orderBy("rel_path", "file_id").limit(1).select("file_id")


def detail_lines(scan, show: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """``part, heading, a, b, line``: the lines of all sections, to be sorted by these; ``only`` (file ids) narrows the sections of files.

    Parts: 1 clean files, 2 hits, 3 secrets (masked), 4 review by tier, 5 exposed URLs, 6 values, URLs, functions and folders shared by files,
    7 tool configuration, 8 files with their counts. ``a`` and ``b`` are the order inside a part.
    """
    names = scan.registry.select("file_id", "rel_path")
    wanted = section_filter(show)
    at = lambda df: (df if only is None else df.join(F.broadcast(only), "file_id", "left_semi")).join(names, "file_id")
    pad = lambda c, n: F.lpad(F.coalesce(c.cast("string"), F.lit("-")), n, " ")
    out: list[DataFrame] = []

    def add(part: int, heading: str, rows: DataFrame, a: Column, b: Column, *line: Column) -> None:
        out.append(rows.select(F.lit(part).alias("part"), F.lit(heading).alias("heading"), a.cast("double").alias("a"), b.cast("string").alias("b"), F.concat_ws("  ", *line).alias("line")))

    path, number = F.col("rel_path"), F.col("line_index") + 1
    place = F.concat(path, F.lit(":"), number)
    order = F.concat(path, F.lpad(F.coalesce(number, F.lit(0)).cast("string"), 10, "0"))
    add(1, "Clean", at(report.clean_files(scan.files.select("file_id"), scan.findings, scan.hits, scan.urls)), F.lit(0), path, path)
    tools = F.col("rule_id").startswith("mcp-")
    if shown("hits", wanted):
        add(2, "Pattern hits", at(scan.hits.where(~tools)), F.lit(0), order, pad(F.col("severity"), 2), F.col("rule_id"), place)
    if shown("secrets", wanted):
        add(3, "Secrets", at(scan.findings), -F.col("pipeline_score"), order, F.col("confidence_calibrated"), S.mask(F.col("value")), place)
    if shown("review", wanted):
        add(4, "Review", at(report.review_tiers(scan.review)), F.col("tier"), order, F.concat(F.lit("tier "), F.col("tier")), S.mask(F.col("value")), place)
    if shown("exposure", wanted):
        add(5, "Exposure", at(report.exposure(scan.urls)), F.lit(0), order, F.col("classification"), F.col("url"), place)
    if only is None:
        for k, (heading, rows, value) in enumerate(scan.correlations()):
            add(6, heading, rows, F.lit(k), value, pad(F.col("file_count"), 6), F.lit("files"), value)
    add(7, "Tool configuration", at(scan.hits.where(tools)), F.lit(0), order, pad(F.col("severity"), 2), F.col("rule_id"), path)
    counts = report.counts_by_file(scan.scores, hits=scan.hits, secrets=scan.findings, review=scan.review, exposure=report.exposure(scan.urls))
    scored = report.per_file(scan.scores.drop("rel_path")).join(counts, "file_id")
    show_axes = [F.concat(F.lit(f"{a} "), F.format_number(f"axis_{a.lower()}", 1)) for a in "ABC"]
    show_counts = [F.concat(F.lit(f"{n} "), F.col(f"n_{n}")) for n in ("hits", "secrets", "review", "exposure")]
    add(8, "Files", at(scored), -F.col("max_axis"), path, *show_axes, *show_counts, path)
    return reduce(DataFrame.unionByName, out)
