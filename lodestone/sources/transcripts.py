"""Transcripts and memories: JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY = "id string, content string, category string, scope string, confidence double, created_at string"


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, role, text, tools) of JSON lines with ``message.role`` and ``message.content`` blocks: texts joined, names of tools used."""
    block = "array<struct<type:string,text:string,name:string>>"
    lines = spark.read.schema(f"message struct<role:string,content:{block}>").json(path).select("message.*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    text = F.array_join(F.transform(F.filter("content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    tools = F.transform(F.filter("content", lambda b: b["type"] == "tool_use"), lambda b: b["name"])
    return lines.filter(F.col("role").isin("user", "assistant")).select("file", "n", "role", text.alias("text"), tools.alias("tools"))


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Memories with the defaults of absent fields: category preference, scope universal, confidence 0.9."""
    return spark.read.schema(MEMORY).option("mode", "FAILFAST").json(path).fillna({"category": "preference", "scope": "universal", "confidence": 0.9})


def import_memories(old: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """New memories added where their id is not there yet, or in place of all."""
    return new if replace else old.unionByName(new.join(old, "id", "left_anti"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, executed) of a coverage report."""
    lines = "struct<executed_lines:array<int>,missing_lines:array<int>>"
    files = spark.read.schema(f"files map<string,{lines}>").option("multiLine", "true").json(path).select(F.explode("files").alias("path", "f"))
    parts = [files.select("path", F.explode(f"f.{c}").alias("line"), F.lit(c == "executed_lines").alias("executed")) for c in ("executed_lines", "missing_lines")]
    return parts[0].union(parts[1])
