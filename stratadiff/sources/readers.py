"""Text and JSON sources as tables with declared schemas. What can't be parsed is null or left out, never a failure of the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.functions import text as T

META = "id string, dependencies map<string,string>, links map<string,string>, fixedVersion string, fixCommit string, sink string"
PROMPTS = "prj_path string, version string, commit_id string, prompt array<struct<prompt:string,context:string,line:array<int>>>, outputs map<string,array<string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _whole(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """file and text of each file. ``missing_ok``: a path that isn't there is an empty table, and files that go meanwhile are left out."""
    try:
        read = spark.read.option("ignoreMissingFiles", missing_ok).text(path, wholetext=True)
    except Exception as missing:
        if not missing_ok or "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "file string, text string")
    return read.select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def _case(depth: int = 2):
    return F.element_at(F.split("file", "/"), -depth).alias("case_id")


def case_paths(spark: SparkSession, path: str) -> DataFrame:
    """A list of case folders, one a line: path, name, version."""
    rows = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    return rows.select("path", T.case_name(F.col("path"))["name"].alias("name"), T.case_name(F.col("path"))["version"].alias("version"))


def case_metadata(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Descriptions in JSON, one a file: case_id and the columns of META; a broken one gives nulls."""
    return _whole(spark, path, missing_ok).select(_case(), F.from_json("text", META).alias("m")).select("case_id", "m.*")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select(_case(), F.element_at(F.split("file", "/"), -1).alias("file"), "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """case_id, file, ord (from 0) and line of each line with text in it."""
    rows = _whole(spark, path).select(_case(), F.element_at(F.split("file", "/"), -1).alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("ord", "line"))
    return rows.where(F.trim("line") != "")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """case_id, file and lines of each file, blank ones too; a final line feed ends the last line. Files without a line have no row."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("lines")).select(_case(), F.element_at(F.split("file", "/"), -1).alias("file"), "lines")


def version_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines `commit version` in order: case_id, ord, commit_id, version."""
    parts = F.split(F.trim("line"), r"\s+")
    return numbered_lines(spark, path).select("case_id", "ord", F.get(parts, 0).alias("commit_id"), F.get(parts, 1).alias("version"))


def oldest(versions: DataFrame) -> DataFrame:
    """The last line of each version map."""
    return versions.groupBy("case_id").agg(F.max(F.struct("ord", "commit_id", "version")).alias("x")).select("case_id", "x.commit_id", "x.version")


def one_token(spark: SparkSession, path: str, name: str = "version") -> DataFrame:
    return _whole(spark, path).select(_case(), F.trim(F.regexp_replace("text", r"\s+$", "")).alias(name))


def locations(spark: SparkSession, path: str) -> DataFrame:
    """Lines `commit##[1, 2]##index`: case_id, tool (name of the file), commit_id, chunk_idx, lines. Of equal keys the last counts."""
    rows = numbered_lines(spark, path).select("case_id", F.regexp_replace("file", r"\.[^.]*$", "").alias("tool"), "ord", F.split("line", "##").alias("p"))
    rows = rows.where(F.size("p") == 3).select("case_id", "tool", "ord", F.get("p", 0).alias("commit_id"), F.trim(F.get("p", 2)).alias("chunk_idx"), F.from_json(F.get("p", 1), "array<int>").alias("lines"))
    return rows.groupBy("case_id", "tool", "commit_id", "chunk_idx").agg(F.max_by("lines", "ord").alias("lines"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt documents, with version, model and method from their names `version@model@method.json`. Keys `<model>-output` are one map."""
    name = F.split(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", ""), "@")
    every = F.from_json("text", "map<string,string>")
    outputs = F.transform_values(F.map_filter(every, lambda k, v: F.endswith(k, F.lit("-output"))), lambda k, v: F.from_json(v, "array<string>"))
    return _whole(spark, path).select(F.get(name, 0).alias("version"), F.get(name, 1).alias("model"), T.locating_method(F.col("file")).alias("method"), F.from_json("text", PROMPTS).alias("d"), outputs.alias("outputs")).select("version", "model", "method", "d.prj_path", "d.commit_id", "d.prompt", "outputs")


def porting_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="pkg string, type string")


def paired_results(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of lines, a path and its status: pkg (last part), cwe (last but one), status."""
    rows = numbered_lines(spark, path).select("file", F.col("line"), (F.row_number().over(W.partitionBy("file").orderBy("ord")) - 1).alias("k"))
    pairs = rows.groupBy("file", F.floor(F.col("k") / 2).alias("pair")).agg(F.min_by("line", "k").alias("path"), F.max_by("line", "k").alias("status"), F.count("*").alias("n")).where("n = 2")
    return pairs.select(T.path_part(F.trim("path"), 1).alias("pkg"), T.path_part(F.trim("path"), 2).alias("cwe"), F.trim("status").alias("status"))


def single_results(spark: SparkSession, path: str) -> DataFrame:
    """Lines `path status`."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(T.path_part(F.get(parts, 0), 1).alias("pkg"), F.get(parts, 1).alias("status"))


def ragged_links(spark: SparkSession, path: str) -> DataFrame:
    """Lines `key,link,link,...` of any length."""
    parts = F.split(F.trim("value"), ",")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).alias("cve"), F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.trim(x)), lambda x: x != "").alias("urls"))


def spaced_pairs(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).alias("cve"), F.get(parts, 1).alias("patch"))


def keyed_object(spark: SparkSession, path: str, value: str = "struct<repo:string,owner:string,origin:string,target:string>") -> DataFrame:
    """A JSON object as rows key, value."""
    return _whole(spark, path).select(F.explode(F.from_json("text", f"map<string,{value}>")).alias("cve", "v")).select("cve", "v.*")


def results(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Result rows in JSON, one array a file or, with ``lines``, one row a line (as the sinks append them); an empty table where
    there is no file yet."""
    try:
        return spark.read.schema(schema).json(path, multiLine=not lines)
    except Exception as missing:  # the path may not exist before the first run
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def flagged_paths(spark: SparkSession, path: str) -> DataFrame:
    """Lines `(True, 'path')`."""
    return spark.read.text(path).select((F.regexp_extract("value", r"\(\s*(True|False)", 1) == "True").alias("flag"), F.regexp_extract("value", r",\s*['\"](.*)['\"]\s*\)", 1).alias("path")).where("path <> ''")


def numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("n")).where("n IS NOT NULL")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: path, name, size, and when each changed; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def read_through(spark: SparkSession, path: str, made) -> DataFrame:
    """The table at ``path``; where there is none yet, that of ``made`` (a function without arguments), written there first."""
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    made().write.parquet(path)
    return spark.read.parquet(path)


def hunk_contents(asked: DataFrame, known: DataFrame, case: str, hunk: str, values: list[str]) -> DataFrame:
    """``asked`` with the values of the entry for its case and hunk; null without one. Entries have ids `case#<word>-hunk`; hunk
    numbers may have several digits, and of several entries one is taken: that of the least id."""
    parts = F.split("id", "#")
    entries = known.select(F.get(parts, 0).alias("__case"), F.regexp_extract(F.get(parts, 1), r"-(\d+)$", 1).try_cast("long").alias("__hunk"), "id", *values)
    one = entries.where("__hunk IS NOT NULL").groupBy("__case", "__hunk").agg(F.min(F.struct("id", *values)).alias("__x"))
    found = asked.join(one, (asked[case] == one["__case"]) & (asked[hunk].cast("long") == one["__hunk"]), "left")
    return found.select(*asked.columns, *(F.col(f"__x.{v}").alias(v) for v in values))
