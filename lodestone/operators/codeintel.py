"""Composites over code facts: overlays, guards, predictions, checks, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions import scores as sc
from lodestone.functions import text as tx
from lodestone.operators.intervals import containing
from lodestone.operators.windows import first_n
from lodestone.session import stored

#: Behaviours, their patterns with weights, and the score from which a text shows them.
BEHAVIORS = {
    "http": ((("(?i)\\brequests?\\.|fetch\\(|http", 0.4), ("(?i)\\b(?:get|post|put|delete)\\(", 0.3)), 0.4),
    "errors": ((("\\b(?:try|except|catch|raise|throw)\\b", 0.6),), 0.0),
    "database": ((("(?i)\\bselect\\b.+\\bfrom\\b|\\binsert into\\b", 0.4), ("(?i)cursor|session|connection", 0.3)), 0.4),
    "files": ((("\\bopen\\(|Path\\(", 0.4), ("\\.(?:read|write)\\(", 0.2)), 0.3),
    "async": ((("\\basync\\b|\\bawait\\b", 0.7),), 0.0),
    "logging": ((("(?i)\\blog(?:ger|ging)?\\.", 0.4),), 0.3),
    "validation": ((("(?i)valid|assert\\b|isinstance\\(", 0.5),), 0.4),
}


def coverage(ranges: DataFrame, lines: DataFrame, key: str, range_id: str) -> DataFrame:
    """(range_id, covered, total, percent): executed lines (key, line, executed) in each range; 100 % where a range has no line that counts."""
    hit = containing(lines, ranges, key, "line", "start", "end")
    got = hit.groupBy(range_id).agg(F.count_if("executed").alias("covered"), F.count("line").alias("total"))
    out = ranges.select(range_id).join(got, range_id, "left").fillna(0, ["covered", "total"])
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("covered") / F.col("total"), 2)).otherwise(100.0))


def guard(symbols: DataFrame, references: DataFrame, key: str, home: str, stability: str) -> DataFrame:
    """(key, outside, verdict): block what others use and is stable, warn of what others use, allow the rest."""
    out = references.join(symbols.select(key, home), key).filter(F.col("file") != F.col(home)).groupBy(key).agg(F.count(F.lit(1)).alias("outside"))
    rows = symbols.join(out, key, "left").fillna(0, ["outside"])
    verdict = F.when(F.col("outside") == 0, "allow").when(F.col(stability) >= 0.75, "block").otherwise("warn")
    return rows.select(key, "outside", verdict.alias("verdict"))


def related(parts: list[tuple[DataFrame, str, float]], key: str, floor: float = 0.5, most: int = 5) -> DataFrame:
    """(key, target, reason, confidence): per key the ``most`` best of the related targets of all parts, each target once.

    A target is told at most once by each confidence, so the best are among so
    many first pairs of a key; Spark takes that limit before the shuffle, and
    what meets in a task are a few rows a key and part of the input.
    """
    best = sorted(parts, key=lambda p: (-p[2], p[1]))
    rows = reduce(DataFrame.unionByName, [p.select(key, "target", F.lit(i).alias("_i"), F.lit(c).alias("confidence")).filter(F.lit(c >= floor)) for i, (p, _, c) in enumerate(best, 1)])
    pairs = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "target"))
    rows = rows.withColumn("_n", pairs).filter(F.col("_n") <= most * len({c for _, _, c in parts}))
    rows = rows.groupBy(key, "target").agg(F.min("_i").alias("_i"))
    told = lambda n: F.element_at(F.array(*[F.lit(p[n]) for p in best]), F.col("_i"))
    return first_n(rows.withColumn("confidence", told(2)), [key], most, F.desc("confidence"), F.col("target")).select(key, "target", told(1).alias("reason"), "confidence")


def hydration(refs: DataFrame, sizes: DataFrame, least: int = 3, most: int = 5, per_symbol: int = 40, budget: int = 2000) -> DataFrame:
    """(src, target, n, tokens): per source the targets with ``least`` references or more, up to ``most`` by references, until the budget breaks."""
    n = refs.groupBy("src", "target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    top = first_n(n, ["src"], most, F.desc("n"), F.col("target")).join(sizes, "target").withColumn("tokens", F.col("symbols") * per_symbol)
    w = Window.partitionBy("src").orderBy(F.desc("n"), "target").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("_u", F.sum("tokens").over(w)).filter(F.col("_u") <= budget).select("src", "target", "n", "tokens")


def violations(files: DataFrame, patterns: dict[str, str], id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, rule, line, snippet): lines that match a pattern, with the lines around, the first ``most`` of all by id, line and rule."""
    lines = files.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "row"))
    w = Window.partitionBy(id_col).orderBy("line")
    around = F.concat_ws("\n", F.lag("row").over(w), F.col("row"), F.lead("row").over(w))
    rules = F.array_compact(F.array(*[F.when(F.col("row").rlike(p), F.lit(name)) for name, p in patterns.items()]))
    hit = lines.withColumn("snippet", around).withColumn("rule", F.explode(rules))
    return hit.select(id_col, "rule", (F.col("line") + 1).alias("line"), "snippet").orderBy(id_col, "line", "rule").limit(most)


def behaviors(text: Column) -> Column:
    """The behaviours that a source text shows, by name."""
    parts = []
    for name, (rules, floor) in BEHAVIORS.items():
        score = sum((F.when(text.rlike(p), w).otherwise(0.0) for p, w in rules), F.lit(0.0))
        parts.append(F.when((score > floor) & (score > 0), F.lit(name)))
    return F.array_compact(F.array(*parts))


def resolve_imports(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(importer, name, path): the definition whose path fits the imported module, else the only one there is; null otherwise.

    ``links`` has (importer, module, names), ``symbols`` (name, path). Ties go to the smaller path.

    Imports meet a row a name, its first and last path, which settles names with
    none or one, so that no task orders all importers of a frequent name. Only
    imports of names that several files define meet all of their paths.
    """
    asked = links.select("importer", "module", F.explode("names").alias("name")).distinct()
    ends = symbols.groupBy("name").agg(F.min("path").alias("path"), F.max("path").alias("last"))
    rows = stored(asked.join(ends.hint("merge"), "name", "left")).hint("merge")  # read twice
    one = rows.filter("path is null or path = last").select("importer", "name", "path")
    several = rows.filter("path != last").select("importer", "module", "name")
    if several.isEmpty():
        return one
    fits = F.coalesce(paths.fits(F.col("path"), paths.module_path(F.col("module"), F.col("importer"))), F.lit(False))
    met = several.join(symbols.select("name", "path").distinct(), "name")
    best = met.groupBy("importer", "module", "name").agg(F.min(F.when(fits, F.col("path"))).alias("path"))
    return one.unionByName(best.select("importer", "name", "path"))


def blueprint(symbols: DataFrame, texts: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(path, name, type, start_line, end_line, parent, branches, lines, nesting, level, deps): symbols with what their lines measure."""
    body = tx.line_range(F.col("text"), F.col("start_line"), F.col("end_line"))
    rows = symbols.join(texts.select("path", "text"), "path").withColumn("_b", body)
    rows = rows.withColumns({"branches": tx.branches(F.col("_b")) + 1, "lines": tx.code_lines(F.col("_b")), "nesting": tx.nesting(F.col("_b"))}).drop("_b", "text")
    rows = rows.withColumn("level", sc.complexity_level(F.col("branches"), F.col("lines")))
    if calls is None:
        return rows.withColumn("deps", F.lit(None).cast("long"))
    inside = containing(calls.select("path", "line", "callee"), symbols, "path", "line", "start_line", "end_line")
    deps = inside.groupBy("path", "name", "start_line").agg(F.count_distinct("callee").alias("deps"))
    return rows.join(deps, ["path", "name", "start_line"], "left").fillna(0, ["deps"])


def context(target: DataFrame, bases: DataFrame, imports: DataFrame, max_tokens: int) -> DataFrame:
    """(name, code, bases, imports): a symbol's code, its bases' and its imports' in 40, 30 and 30 percent of a budget of tokens (4 characters each)."""
    cut = lambda c, share: F.left(c, F.lit(int(4 * max_tokens * share)))
    b = bases.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: x["code"]), "\n").alias("bases"))
    i = imports.groupBy("name").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda x: x["code"]), 1, 20), "\n").alias("imports"))
    rows = target.join(b, "name", "left").join(i, "name", "left").fillna("", ["bases", "imports"])
    return rows.select("name", cut(F.col("code"), 0.4).alias("code"), cut(F.col("bases"), 0.3).alias("bases"), cut(F.col("imports"), 0.3).alias("imports"))


#: Rules and how much a violation of each weighs.
SEVERITY = {"layer_separation": "high", "type_coverage": "medium", "docstring_coverage": "medium", "async_boundaries": "high", "import_restrictions": "high"}


def architecture(files: DataFrame, functions: DataFrame, imports: DataFrame, forbidden: dict[str, tuple[str, ...]], layers: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(path, rule, severity, what): functions (path, name, documented, hinted) without hints or docstrings, modules that the files below a folder may not import, modules of a layer that another may not use, and waiting calls in async functions.

    ``forbidden``: folder to modules; ``layers``: (folder, module prefix) that do not go together.
    """
    put = lambda df, rule, what: df.select("path", F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), what.alias("what"))
    nowhere = F.lit(False)
    banned = reduce(lambda a, b: a | b, [F.col("path").startswith(f) & F.col("module").isin(*m) for f, m in forbidden.items()], nowhere)
    crossed = reduce(lambda a, b: a | b, [F.col("path").startswith(f) & F.col("module").startswith(m) for f, m in layers], nowhere)
    # An async function's body: the lines below it that are indented further.
    waits = F.regexp_extract_all("text", F.lit("(?m)^([ \t]*)async def (\\w+)[^\n]*(?:\n(?:\\1[ \t]+[^\n]*|[ \t]*))*?\n\\1[ \t]+[^\n]*\\b(?:time\\.sleep|requests\\.\\w+|open)\\("), F.lit(2))
    parts = [
        put(functions.filter("not hinted"), "type_coverage", F.col("name")),
        put(functions.filter("not documented"), "docstring_coverage", F.col("name")),
        put(imports.filter(banned), "import_restrictions", F.col("module")),
        put(imports.filter(crossed), "layer_separation", F.col("module")),
        put(files.withColumn("_w", F.explode(waits)), "async_boundaries", F.col("_w")),
    ]
    return reduce(DataFrame.unionByName, parts)


def severities(violations_: DataFrame, key: str) -> DataFrame:
    """(key, status, summary): fail with a high or critical violation, warnings with any; the counts from the worst severity on."""
    names = ("critical", "high", "medium", "low")
    n = violations_.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in names])
    status = F.when((F.col("critical") > 0) | (F.col("high") > 0), "fail").when((F.col("medium") > 0) | (F.col("low") > 0), "warnings").otherwise("pass")
    some = F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in names]))
    return n.select(key, status.alias("status"), F.array_join(some, ", ").alias("summary"))


def examples(files: DataFrame, pattern: str, most: int) -> DataFrame:
    """(path, line, snippet): of the first ``most`` files that have a line with the pattern the first such line, with the line before and three behind."""
    lines = F.split("text", "\n")
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())
    rows = files.filter(F.col("text").rlike(pattern)).select("path", lines.alias("_l"), hits[0].alias("line")).orderBy("path").limit(most)
    first = F.greatest(F.lit(1), F.col("line") - 1)
    around = F.array_join(F.slice("_l", first, F.col("line") + 3 - first + 1), "\n")
    return rows.select("path", "line", F.regexp_replace(around, "^\\s+|\\s+$", "").alias("snippet"))
