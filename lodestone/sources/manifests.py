"""A small JSON file in the shared folder that names the current files of a table, replaced in one step."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, place, place.getFileSystem(conf)


def read(spark: SparkSession, path: str) -> dict | None:
    """What the file at ``path`` holds; None where there is none."""
    jvm, _, place, fs = _file(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put(spark: SparkSession, path: str, value: dict, mark: str) -> None:
    """Writes ``value`` to a file of its own, named by ``mark``, and renames it over ``path``: readers see the old or the new one."""
    jvm, conf, place, fs = _file(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}-{mark}")
    out = fs.create(new, True)
    out.write(json.dumps(value, sort_keys=True).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(place), options)
