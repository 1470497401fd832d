"""Label text files, class dictionaries, run metrics and champion files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_labels(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) with ``class cx cy w h`` to canonical labels; malformed lines have NULL numbers."""
    part = F.split(F.trim("line"), r"\s+")
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    return lines.filter(F.trim("line") != "").select(
        F.regexp_extract("path", r"([^/]+)/labels/[^/]+$", 1).alias("split"),
        F.regexp_extract(name, r"^(.*?)_\d+_\d+_png", 1).alias("clip"),
        name.alias("image"),
        F.col("line_no").cast("int").alias("line_no"),
        number(0).cast("int").alias("class_id"),
        *(number(k).alias(c) for k, c in enumerate(("cx", "cy", "w", "h"), 1)),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Files are read whole: they end without a line break, and the number of a line counts within its file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_labels(files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of a data.yaml's ``names: [...]`` or list of ``- name``."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    inline = re.search(r"^names:\s*\[([^\]]*)\]", text, re.M)
    names = [n.strip(" '\"") for n in inline[1].split(",")] if inline else re.findall(r"^\s*-\s*['\"]?([^'\"\n]+)", text[text.find("names:") :], re.M)
    return spark.createDataFrame([(k, n) for k, n in enumerate(names) if n], "class_id int, name string")


def rewrite_paths(text: DataFrame, root: str, column: str = "value") -> DataFrame:
    """``train:``, ``val:`` and ``test:`` lines of a data.yaml with paths below ``root``."""
    value = F.col(column)
    for key, folder in (("train", "train"), ("val", "valid"), ("test", "test")):
        value = F.regexp_replace(value, rf"^({key}: ).*", f"$1{root}/{folder}/images")
    return text.withColumn(column, value)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """results.csv as (run, epoch, metric, value); column names lose their padding."""
    wide = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    wide = wide.toDF(*(c.strip() for c in wide.columns))
    metrics = [c for c in wide.columns if c != "epoch"]
    return wide.withColumn("run", F.col("_metadata.file_path") if "run" not in wide.columns else F.col("run")).select(
        "run", F.col("epoch").try_cast("int").alias("epoch"), *(F.col(f"`{m}`").try_cast("double").alias(m) for m in metrics if m != "run")
    ).unpivot(["run", "epoch"], [m for m in metrics if m != "run"], "metric", "value")


def previous_best(spark: SparkSession, text: str | None) -> float:
    """Best score of a meta.json's text; minus infinity where it is missing or damaged."""
    try:
        return float(json.loads(text or "")["best_score"])
    except (ValueError, KeyError, TypeError):
        return float("-inf")


def read_previous_best(spark: SparkSession, path: str) -> float:
    """Best score of a meta.json; minus infinity where the file is missing, empty or damaged."""
    if first_existing(spark, [path]) is None:
        return float("-inf")
    rows = spark.read.schema("best_score double, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    best = rows.agg(F.max("best_score")).first()[0]
    return float("-inf") if best is None else best


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists in the store it names."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return p
    return None


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...], at_least: int) -> list[str]:
    """Sorted names of files with one of the suffixes; too few raise."""
    glob = "*{" + ",".join(suffixes) + "}"
    found = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path").collect())
    if len(found) < at_least:
        raise FileNotFoundError(f"{len(found)} files with {', '.join(suffixes)} in {path}; {at_least} are needed")
    return found
