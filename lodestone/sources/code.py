"""Source trees as DataFrames: scan, extract, write, read back."""

from __future__ import annotations

import itertools
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.functions import parsing
from lodestone.session import stored

#: Folders that are never read, and the largest file.
IGNORED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".pytest_cache")
MAX_BYTES = 1 << 20
FACTS = ("symbols", "imports", "calls", "types", "bases")


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = tuple(parsing.LANGUAGES), max_bytes: int | None = MAX_BYTES, newer_than: str | None = None) -> DataFrame:
    """(path, modified, size, text) of the source files below ``folder``; ``newer_than`` leaves out older ones before they are read.

    ``max_bytes`` leaves out larger files, which :func:`too_large` lists; with
    None all are read.
    """
    files = _files(spark, folder, suffixes, newer_than)
    files = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def too_large(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = tuple(parsing.LANGUAGES), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size) of the files that :func:`scan` leaves out at that bound."""
    return _files(spark, folder, suffixes, None).filter(F.col("length") > max_bytes).select("path", F.col("length").alias("size"))


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...], newer_than: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    if newer_than:
        reader = reader.option("modifiedAfter", newer_than)
    skip = "/(?:" + "|".join(d.replace(".", "\\.") for d in IGNORED) + ")/"
    return reader.load(folder).filter(~F.col("path").rlike(skip))


#: Fixed value: files whose rows a worker holds at once.
AT_ONCE = 500


def _rows(files: DataFrame, schema: str, make: Callable[[str, str], list[tuple]]) -> DataFrame:
    """(path, *schema): the rows that ``make`` gives for each file's path and text."""
    kinds, arrow = _schema(files, f"path string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]):
        for paths, texts in _some(batches):
            out = [(p, *r) for p, t in zip(paths, texts, strict=True) for r in make(p or "", t or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    # A file gives many rows, which Spark's estimate by the bytes of a table knows nothing of: a join that trusts it would gather them on the driver.
    return files.select("path", "text").mapInArrow(run, kinds).hint("merge")


def _schema(files: DataFrame, schema: str) -> tuple[StructType, pa.Schema]:
    kinds = files.sparkSession.createDataFrame([], schema).schema
    return kinds, to_arrow_schema(kinds)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """The first two columns of batches, some rows at a time, so that what a worker holds does not grow with Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            yield some.column(0).to_pylist(), some.column(1).to_pylist()


def _calls(path: str, text: str) -> list[tuple]:
    return parsing.calls(text) if parsing.language(path) not in (None, "markdown") else []


def _documented(path: str, text: str) -> list[tuple]:
    return parsing.documented(text) if parsing.language(path) == "python" else []


#: What is told of a file, by name: the columns beside the path, and what makes their rows of a path and a text.
MAKERS = {
    "symbols": (parsing.SYMBOL, parsing.symbols),
    "imports": ("module string, names array<string>, line int", parsing.imports),
    "calls": ("receiver string, callee string, line int", _calls),
    "types": ("name string, annotation string, how string, line int", parsing.types),
    "bases": ("cls string, base string, ord int", parsing.bases),
    "base_imports": ("module string, names array<string>, line int", parsing.base_imports),
    "documented": ("name string, documented boolean, hinted boolean", _documented),
}


def facts(files: DataFrame, *names: str) -> list[DataFrame]:
    """The facts of files by their names in ``MAKERS``, as the functions of those names give them, for what reads several of them or one several times.

    One pass makes a row a file with a list of each, in which its text is parsed
    once, and writes it to the shared folder.
    """
    kinds, arrow = _schema(files, "path string, " + ", ".join(f"{n} array<struct<{MAKERS[n][0]}>>" for n in names))

    def run(batches: Iterator[pa.RecordBatch]):
        for paths, texts in _some(batches):
            found = [[MAKERS[n][1](p or "", t or "") for n in names] for p, t in zip(paths, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[_lists(c, kind) for c, kind in zip(zip(*found, strict=True), arrow.types[1:], strict=True)]], schema=arrow)

    rows = stored(files.select("path", "text").mapInArrow(run, kinds))
    return [rows.select("path", F.inline(n)).hint("merge") for n in names]


def _lists(rows: tuple[list[tuple], ...], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs."""
    ends = pa.array(itertools.accumulate(map(len, rows), initial=0), pa.int32())
    fields = list(kind.value_type)
    columns = list(zip(*itertools.chain.from_iterable(rows), strict=True)) or [()] * len(fields)
    inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(ends, inner, type=kind)


#: Symbols a file and in all, from which share of these a warning is due.
PER_FILE, IN_ALL, WARN = 500, 100_000, 0.8


def symbols(files: DataFrame) -> DataFrame:
    """All symbols of files; :func:`limited` bounds them where that is wanted."""
    return _rows(files, *MAKERS["symbols"])


def limited(found: DataFrame, per_file: int = PER_FILE) -> tuple[DataFrame, DataFrame]:
    """(the first ``per_file`` symbols of each file by line and name, (path, total, dropped, warning) of the files near or over that)."""
    w = Window.partitionBy("path").orderBy("start_line", "type", "name")
    kept = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_file).drop("_n")
    return kept, over_limit(found, per_file)


def over_limit(found: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(path, total, dropped, warning) of the files that have at least ``WARN`` of the symbols that a file may have."""
    n = found.groupBy("path").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= WARN * per_file)
    return n.select("path", "total", F.greatest(F.lit(0), F.col("total") - per_file).cast("long").alias("dropped"), F.when(F.col("total") > per_file, "truncated").otherwise("near the limit").alias("warning"))


def imports(files: DataFrame) -> DataFrame:
    return _rows(files, *MAKERS["imports"])


def calls(files: DataFrame) -> DataFrame:
    return _rows(files, *MAKERS["calls"])


def types(files: DataFrame) -> DataFrame:
    return _rows(files, *MAKERS["types"])


def bases(files: DataFrame) -> DataFrame:
    return _rows(files, *MAKERS["bases"])


def skeletons(files: DataFrame, keep: tuple[str, ...] = (), shapes: bool = True) -> DataFrame:
    """(path, skeleton, shape) of Python files; without ``shapes``, which take longer than skeletons, (path, skeleton)."""

    def make(path, text):
        if parsing.language(path) != "python":
            return []
        skeleton = parsing.skeleton(text, frozenset(keep))
        return [(skeleton, parsing.shape(text)) if shapes else (skeleton,)]

    return _rows(files, "skeleton string, shape string" if shapes else "skeleton string", make)


def script_skeletons(files: DataFrame) -> DataFrame:
    """(path, skeleton, summary) of JavaScript and TypeScript files."""

    def make(path, text):
        return [(parsing.script_skeleton(text), parsing.summary(text))] if parsing.language(path) in ("javascript", "typescript") else []

    return _rows(files, "skeleton string, summary string", make)


def documented(files: DataFrame) -> DataFrame:
    """(path, name, documented, hinted) of the functions of Python files that parse."""

    return _rows(files, *MAKERS["documented"])


def valid(files: DataFrame) -> DataFrame:
    """(path, valid) of the files whose syntax can be told."""

    def make(path, text):
        ok = parsing.valid(path, text)
        return [] if ok is None else [(ok,)]

    return _rows(files, "valid boolean", make)


def same_shape(df: DataFrame, before: str, after: str) -> DataFrame:
    """``df`` with ``same``: whether two Python texts differ in comments, layout and docstrings at most; null where one does not parse."""

    @F.arrow_udf("boolean")
    def same(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else parsing.same(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return df.withColumn("same", same(before, after))


def diffs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, path, status, start, end, change) of a table of unified diffs: a row per hunk."""
    return _rows(rows.select(F.col(id_col).cast("string").alias("path"), F.col(text_col).alias("text")), "file string, status string, start int, end int, change string", lambda _, text: parsing.diff_ranges(text)).withColumnsRenamed({"path": "id", "file": "path"})


def blames(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, commit, author, at) of a table of blame outputs."""
    got = _rows(rows.select(F.col(id_col).cast("string").alias("path"), F.col(text_col).alias("text")), "line int, commit string, author string, seconds string", lambda _, text: parsing.blame(text))
    return got.select(F.col("path").alias("id"), "line", "commit", "author", F.col("seconds").cast("long").alias("at"))


def statuses(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, status, path, old) of a table of name-status outputs."""
    return _rows(rows.select(F.col(id_col).cast("string").alias("path"), F.col(text_col).alias("text")), "status string, file string, old string", lambda _, text: parsing.name_status(text)).withColumnsRenamed({"path": "id", "file": "path"})


def write_index(files: DataFrame, folder: str) -> None:
    """All fact tables of ``files`` as Parquet below ``folder``."""
    for name in FACTS:
        globals()[name](files).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in FACTS}


def diff(spark: SparkSession, text: str) -> DataFrame:
    """A unified diff as rows."""
    return spark.createDataFrame(parsing.diff_ranges(text), "path string, status string, start int, end int, change string")


def commits(spark: SparkSession, folder: str, most: int = 100, since: str | None = None) -> DataFrame:
    """(hash, subject) of the newest commits of a git folder on the driver."""
    call = ["git", "-C", folder, "log", f"-{most}", "--pretty=%H%x09%s", *([f"--since={since}"] if since else [])]
    rows = [tuple(x.split("\t", 1)) for x in subprocess.run(call, capture_output=True, text=True, check=True).stdout.splitlines()]
    return spark.createDataFrame(rows, "hash string, subject string")


def call_edges(calls_: DataFrame, symbols_: DataFrame) -> DataFrame:
    """(src, dst, path, line): each call within the innermost function that holds it."""
    from lodestone.operators.intervals import containing

    inner = symbols_.filter(F.col("type").isin("function", "method")).select("path", F.col("name").alias("src"), "start_line", "end_line")
    hit = containing(calls_, inner, "path", "line", "start_line", "end_line")
    return hit.groupBy("path", "line", F.col("callee").alias("dst")).agg(F.min_by("src", F.struct(F.col("end_line") - F.col("start_line"), "src")).alias("src"))


def commit_log(spark: SparkSession, path: str, since: str | None = None, most: int | None = None) -> DataFrame:
    """(hash, at, subject) of exported logs at ``path``, lines ``hash|time|subject``: those from ``since`` on, the newest ``most`` of them, ties by hash. Other lines are left out."""
    part = F.split("value", "\\|", 3)
    rows = spark.read.text(path).filter(F.size(part) == 3).select(part[0].alias("hash"), part[1].try_cast("timestamp_ntz").alias("at"), part[2].alias("subject")).filter("at is not null")
    rows = rows if since is None else rows.filter(F.col("at") >= F.lit(since).cast("timestamp_ntz"))
    return rows if most is None else rows.orderBy(F.desc("at"), "hash").limit(most)
