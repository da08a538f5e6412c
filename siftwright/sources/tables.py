"""Sources: the file table in its scanned form, lines, changed paths, configuration documents.

``files`` keeps one row a file (the earliest ingested of repeated ones), the six scanned extensions in any case and
no skipped folder. Missing tables or folders are the caller's business; an empty table gives an empty frame with
the same schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import plain_unions

#: Scanned extensions and folder names that are never entered; fixed values.
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", "coverage", ".cache", ".parcel-cache", ".turbo", "out", "__pycache__", ".nyc_output")

FILES = T.StructType(
    [T.StructField("file_id", T.LongType()), T.StructField("rel_path", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("size", T.LongType()),
     T.StructField("depth", T.IntegerType()), T.StructField("content", T.StringType())]
)


def one_each(records: DataFrame) -> DataFrame:
    """The earliest ingested row of each file; of equally early ones the first by path, size and content.

    Only files that come more than once are compared: they are found on two narrow columns, and whole rows are sorted for them alone.
    """
    plain_unions(records.sparkSession)
    known = records.where("file_id IS NOT NULL")
    again = known.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").select("file_id")
    ties = [c for c in ("relative_path", "size", "content") if c in records.columns]
    order = Window.partitionBy("file_id").orderBy("ingested_at", *ties)
    first = known.join(again, "file_id", "left_semi").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return known.join(again, "file_id", "left_anti").unionByName(first)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))


def skipped(path: Column) -> Column:
    names = "|".join(n.replace(".", r"\.") for n in SKIPPED)
    return path.rlike(rf"(?:^|/)(?:{names})/")


def files(records: DataFrame) -> DataFrame:
    """Scanned files of a file table: ``file_id, rel_path, ext, size, depth, content``."""
    kept = one_each(records).where(extension(F.col("relative_path")).isin(*EXTENSIONS) & ~skipped(F.col("relative_path")))
    return kept.select(
        "file_id", F.col("relative_path").alias("rel_path"), extension(F.col("relative_path")).alias("ext"), F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("size"),
        depth(F.col("relative_path")).alias("depth"), "content",
    )


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def folder(spark: SparkSession, root: str) -> DataFrame:
    """Scanned files under a folder or of one file, read whole as UTF-8; a missing root gives no rows."""
    import os

    local = root.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        return spark.createDataFrame([], FILES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(os.path.abspath(local) if "://" not in local else local), r"/+\z", "")
    path = F.regexp_replace("path", "^file:/+", "/")
    single = os.path.isfile(local)
    rel = F.element_at(F.split(path, "/"), -1) if single else F.substring(path, F.length(base) + 2, 1 << 20)
    rows = raw.select(F.xxhash64("path").alias("file_id"), rel.alias("rel_path"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    kept = rows.where(extension(F.col("rel_path")).isin(*EXTENSIONS) & (F.lit(single) | ~skipped(F.col("rel_path"))))
    return kept.select("file_id", "rel_path", extension(F.col("rel_path")).alias("ext"), "size", depth(F.col("rel_path")).alias("depth"), "content")


def lines(scanned: DataFrame) -> DataFrame:
    """``file_id, line_index, line``: content cut at newlines, carriage returns kept; null content has no lines."""
    return scanned.where("content IS NOT NULL").select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("line_index", "line"))


def placed_lines(scanned: DataFrame) -> DataFrame:
    """``lines`` with their file's ``rel_path, ext, n_lines``, so that what needs these needs no join."""
    cut = scanned.where("content IS NOT NULL").select("file_id", "rel_path", "ext", F.split("content", "\n", -1).alias("_l"))
    return cut.select("file_id", "rel_path", "ext", F.size("_l").alias("n_lines"), F.posexplode("_l").alias("line_index", "line"))


def changed(scanned: DataFrame, paths: DataFrame) -> DataFrame:
    """Files whose path is among the changed ones."""
    return scanned.join(paths.select(F.col("path").alias("rel_path")).distinct(), "rel_path", "left_semi")


def changed_paths(spark: SparkSession, root: str, since: str) -> DataFrame | None:
    """``path`` of the scanned files that git says differ from ``since``; nothing where git cannot say, and the caller scans all."""
    import subprocess

    try:
        done = subprocess.run(["git", "diff", "--name-only", "--relative", "--diff-filter=d", since, "--", "."], cwd=root, capture_output=True, text=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    names = [(n,) for n in done.stdout.splitlines() if n.lower().endswith(EXTENSIONS)]
    return spark.createDataFrame(names, "path string")


def corpus(spark: SparkSession, root: str) -> DataFrame | None:
    """One row ``human, ai``: the two reference texts (``human.js.gz``, ``ai.js.gz``); nothing unless both are there.

    Two texts of known size, so what reads them may broadcast them.
    """
    import gzip
    import os

    texts = []
    for name in ("human", "ai"):
        try:
            with gzip.open(os.path.join(root, f"{name}.js.gz"), "rt", encoding="utf-8", errors="replace") as f:
                texts.append(f.read())
        except OSError:
            return None
    return spark.createDataFrame([tuple(texts)], "human string, ai string")


def config_documents(spark: SparkSession, root: str, names: tuple[str, ...] = (".vscode/mcp.json", ".cursor/mcp.json", ".vscode/settings.json")) -> DataFrame:
    """``path, document`` of the tool configuration files found under ``root``; unreadable ones are left out later by parsing."""
    import os

    there = [os.path.join(root, n) for n in names if os.path.isfile(os.path.join(root, n))]
    if not there:
        return spark.createDataFrame([], "path string, document string")
    return spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
