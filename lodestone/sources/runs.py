"""Run folders <root>/<project>/<run>/<file>: catalog, JSON artefacts, models and their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that a block model of each kind must have, version 3.0 of the contract.
REQUIRED = ("run_type", "schema_version")
BY_KIND = {"gravity": ("x", "y", "z", "density"), "magnetic": ("x", "y", "z", "susceptibility_si"), "joint": ("x", "y", "z", "density", "susceptibility_si"), "focusing": ("x", "y", "z", "msx_score")}


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """project, run, file, bytes, modified of every file; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    part = lambda k: F.element_at(parts, F.lit(-k))
    return files.select(part(3).alias("project"), part(2).alias("run"), part(1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def runs(files: DataFrame) -> DataFrame:
    """project, run, the number of files, and which artefacts there are."""
    return files.groupBy("project", "run").agg(F.count("*").alias("files"), F.bool_or(F.col("file").endswith(".parquet")).alias("has_model"), F.bool_or(F.col("file").endswith(".json")).alias("has_json"), F.max("modified").alias("modified"))


def artefacts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """project, run, file, payload and error (true where the text is no JSON of that schema) of every JSON file."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    parts = F.split(F.input_file_name(), "/")
    part = lambda k: F.element_at(parts, F.lit(-k))
    parsed = F.from_json("value", f"struct<{schema}, _bad: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return texts.select(part(3).alias("project"), part(2).alias("run"), part(1).alias("file"), parsed.alias("p")).select("project", "run", "file", F.when(F.col("p._bad").isNull(), F.col("p").dropFields("_bad")).alias("payload"), F.col("p._bad").isNotNull().alias("error"))


def model_of_run(files: DataFrame, project: str | None, run: str | None, name: str | None = None, legacy: tuple[str, ...] = ("block_model_001.parquet",), strict: bool = False) -> str | None:
    """project/run/file of a model in a catalog(): a run's own one, else the first legacy file that is there.

    Without a project and run, strict refuses to guess unless a file is named.
    """
    if project and run:
        wanted = [(project, run, name or "block_model.parquet")]
    else:
        if strict and not (name or "").strip():
            raise ValueError("give a project and run, or a file; there is no silent fall-back")
        wanted = [(None, None, n) for n in ((name,) if name else ()) + (() if strict else legacy)]
    for p, r, n in wanted:  # a few names
        found = files.where(F.col("file") == n)
        found = found.where((F.col("project") == p) & (F.col("run") == r)) if p else found
        got = found.orderBy("project", "run").select("project", "run", "file").limit(1).collect()
        if got:
            return "/".join(got[0])
    return None


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, sha256 of every file of a run's folder; hashed in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def model_problems(model: DataFrame) -> list[str]:
    """What a block model lacks of its contract; one row is read."""
    missing = [c for c in REQUIRED if c not in model.columns]
    if missing:
        return [f"missing {c}" for c in missing]
    row = model.select(*REQUIRED).limit(1).collect()
    if not row:
        return ["no rows"]
    if row[0]["run_type"] not in BY_KIND:
        return [f"unknown run_type {row[0]['run_type']}"]
    return [f"missing {c}" for c in BY_KIND[row[0]["run_type"]] if c not in model.columns]
