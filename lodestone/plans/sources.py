"""Queries that write files to the shared folder and read them with the sources: transcripts, memories, reports, source trees."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import graph
from lodestone.operators import resolution as rs
from lodestone.operators.search import bm25_terms
from lodestone.plans import project as pj
from lodestone.plans.base import query
from lodestone.plans.facts import PY
from lodestone.plans.probes import pick
from lodestone.session import shared_dir, table
from lodestone.sources import code, transcripts


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _transcript(spark, d):
    c = table(spark, d, "conversations")
    block = lambda kind, text, name: F.struct(F.lit(kind).alias("type"), text.alias("text"), name.alias("name"))
    none = F.lit(None).cast("string")
    tool = F.when(F.col("turn") % 3 == 0, F.lit("Edit")).when(F.col("turn") % 3 == 1, F.lit("Bash")).otherwise(F.lit("Write"))
    blocks = F.when(F.col("role") == "assistant", F.array(block("text", F.col("text"), none), block("tool_use", none, tool))).otherwise(F.array(block("text", F.col("text"), none)))
    folder = _folder(spark, "transcript")
    c.select(F.to_json(F.struct(F.struct("role", blocks.alias("content")).alias("message"), "conv_id", "turn")).alias("value")).write.text(folder)
    return transcripts.transcript(spark, folder)


@query("""SELECT role, text, array_to_string(CASE WHEN role = 'assistant' THEN [CASE turn % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Bash' ELSE 'Write' END] ELSE []::VARCHAR[] END, ',') AS tools FROM conversations WHERE role IN ('user', 'assistant')""")
def transcript_turns(spark, d):
    """[S24] Transcripts of JSON lines: roles, texts and tools, other roles left out."""
    return _transcript(spark, d).select("role", "text", F.array_join("tools", ",").alias("tools"))


@query("""SELECT CASE turn % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Bash' ELSE 'Write' END AS tool, count(*)::BIGINT AS uses FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def tool_calls(spark, d):
    """[S25, Q68] The tools that transcripts use, and how often."""
    return _transcript(spark, d).select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("uses"))


@query("""SELECT c_custkey::VARCHAR AS id, 'm' || c_custkey AS content, CASE WHEN c_custkey % 2 = 0 THEN 'rule' ELSE 'preference' END AS category, CASE WHEN c_custkey % 3 = 0 THEN 'project:p' ELSE 'universal' END AS scope, CASE WHEN c_custkey % 5 = 0 THEN 5e-1::DOUBLE ELSE 9e-1::DOUBLE END AS confidence FROM customer""")
def memories_read(spark, d):
    """[S9, S23, Q38, Q39] Memories of JSON lines, with the defaults of what they leave out."""
    k = F.col("c_custkey")
    row = F.struct(k.cast("string").alias("id"), F.concat(F.lit("m"), k.cast("string")).alias("content"), F.when(k % 2 == 0, "rule").alias("category"), F.when(k % 3 == 0, "project:p").alias("scope"), F.when(k % 5 == 0, 0.5).alias("confidence"))
    folder = _folder(spark, "memories")
    table(spark, d, "customer").select(F.to_json(row).alias("value")).write.text(folder)
    return transcripts.read_memories(spark, folder).select("id", "content", "category", "scope", "confidence")


@query("""SELECT 'f' || n_nationkey || '.py' AS path, unnest([1, 2, 10 + n_regionkey, 40]) AS line, unnest([true, true, true, false]) AS executed FROM nation""")
def coverage_report(spark, d):
    """[S30] A coverage report as rows: the lines of each file that ran and that did not."""
    lines = F.struct(F.array(F.lit(1), F.lit(2), 10 + F.col("n_regionkey")).alias("executed_lines"), F.array(F.lit(40)).alias("missing_lines"))
    entry = F.struct(F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("key"), lines.alias("value"))
    folder = _folder(spark, "coverage")
    # One document for all of the few nations, as a report is one document.
    table(spark, d, "nation").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("files"))).alias("value")).coalesce(1).write.text(folder)
    return transcripts.coverage(spark, folder)


def _written(files, folder: str):
    """Each row's text as a file of its path below ``folder``."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{base}/{path}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@query("""WITH n AS (SELECT n_nationkey::BIGINT + 1 AS k FROM nation) SELECT 'docs/n' || k || '.md' AS path, unnest(['Title ' || k, 'Part ' || k, 'n' || k]) AS name, unnest(['section', 'section', 'file']) AS type FROM n
UNION ALL SELECT 'core/r' || k || '.rs', unnest(['r' || k, 'P' || k, 'K' || k, 'T' || k, 'go', 'P' || k, 'go']), unnest(['file', 'struct', 'enum', 'trait', 'function', 'impl', 'function']) FROM n""")
def scanned_tree(spark, d):
    """[S1-S3, S5, S15] A source tree on disk: scanned, folders that are never read left out, its facts written as an index and read again."""
    root = _folder(spark, "tree")
    files = pj.note_files(spark, d).union(pj.compiled_files(spark, d).filter("path like 'core/%'"))
    _written(files.union(files.select(F.concat(F.lit("node_modules/"), "path"), "text")), root)
    found = code.scan(spark, root)
    code.write_index(found, f"{root}/.index")
    inside = F.regexp_extract("path", "/((?:docs|core)/[^/]+)$", 1)
    return code.read_index(spark, f"{root}/.index")["symbols"].select(inside.alias("path"), "name", "type")


#: Memories to search: a text by the customer's number.
NOTES = ["Prefer tests of c#", "Testing pays for module #", "Log errors of service # early and often", "Keep handlers of # small and tested"]
STEM = "CASE WHEN x LIKE '%ing' AND length(x) > 5 THEN left(x, length(x) - 3) WHEN x LIKE '%ed' AND length(x) > 4 THEN left(x, length(x) - 2) WHEN x LIKE '%s' AND length(x) > 3 THEN left(x, length(x) - 1) ELSE x END"


@query(f"""WITH m AS (SELECT c_custkey::BIGINT AS id, replace(list_extract({NOTES!r}, (c_custkey % 4 + 1)::INTEGER), '#', c_custkey::VARCHAR) AS content, (c_custkey % 10) / 1e1 AS confidence FROM customer),
t AS (SELECT *, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS w FROM m), s AS (SELECT id, content, confidence, list_transform(w, lambda x: {STEM}) AS w FROM t),
c AS (SELECT *, len(w)::DOUBLE AS dl, len(list_filter(w, lambda x: x = 'error'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'test'))::DOUBLE AS b FROM s), g AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, sum((a > 0)::INT)::DOUBLE AS da, sum((b > 0)::INT)::DOUBLE AS db FROM c)
SELECT id, round(ln((n-da+5e-1)/(da+5e-1)+1e0)*a*25e-1/(a+15e-1*(25e-2+75e-2*dl/av)) + ln((n-db+5e-1)/(db+5e-1)+1e0)*b*25e-1/(b+15e-1*(25e-2+75e-2*dl/av)), 6) AS score FROM c, g WHERE a + b > 0 AND confidence >= 5e-1""")
def memory_search(spark, d):
    """[R12, J2, F8] Memories by the stems of a query's words, with a filter on how sure they are."""
    k = F.col("c_custkey").cast("long")
    m = table(spark, d, "customer").select(k.alias("id"), F.replace(pick(NOTES, k), F.lit("#"), k.cast("string")).alias("content"), ((k % 10) / 10.0).alias("confidence"))
    stems = m.select("id", F.transform(tx.tokens(F.col("content")), tx.stem).alias("terms"))
    found = bm25_terms(stems, ["error", "test"], "id", "terms")
    return found.join(m.filter("confidence >= 0.5").select("id"), "id").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {PY}, e AS (SELECT 'make' || k AS src, 'make' || p AS dst FROM p WHERE NOT b), t AS (SELECT dst AS root, src AS name, 1 AS depth FROM e UNION ALL SELECT root, e.src, depth + 1 FROM t JOIN e ON e.dst = t.name WHERE depth < 3)
SELECT root, name, depth::INTEGER AS depth FROM t""")
def caller_tree(spark, d):
    """[G3, G4] Who calls a function, who calls those, up to three steps; each name once a step."""
    symbols, calls = code.facts(pj.python_files(spark, d), "symbols", "calls")
    found = rs.callers(calls.filter("receiver is null and callee like 'make%'"), symbols.filter("type = 'function'"))
    return graph.caller_tree(found.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), 3)
