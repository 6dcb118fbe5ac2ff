"""What a change touches: tests, callers, symbols of changed lines, branches; and what a project is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import scores as sc
from lodestone.operators import intervals as iv
from lodestone.operators.windows import first_n

# Fixed values.
#: Query words of each behaviour.
ASKED = {
    "http": ("http", "request", "api", "fetch", "download", "upload", "rest", "endpoint"),
    "errors": ("error", "exception", "handle", "catch", "try", "except"),
    "database": ("database", "query", "sql", "select", "insert", "update", "delete", "db"),
    "files": ("file", "read", "write", "open", "save", "load", "i/o", "io"),
    "async": ("async", "await", "asyncio", "concurrent", "parallel"),
    "logging": ("log", "logger", "logging", "debug", "info", "warn", "error"),
    "validation": ("validate", "validation", "check", "verify", "dataclass", "pydantic"),
}
#: Words in a project's manifest and the technology that each tells of.
STACKS = {
    "python": {"fastapi": "FastAPI", "django": "Django", "flask": "Flask", "pytest": "pytest", "sqlalchemy": "SQLAlchemy", "tree-sitter": "Tree-sitter"},
    "go": {"chi": "Chi (HTTP router)", "gin": "Gin (Web framework)", "echo": "Echo (Web framework)", "fiber": "Fiber (Web framework)", "templ": "Templ (Templating)", "htmx": "htmx", "pgx": "PostgreSQL", "sqlc": "sqlc (SQL generator)", "gorm": "GORM (ORM)", "cobra": "Cobra (CLI framework)"},
}
# End of fixed values.


def behaviors_asked(query: Column) -> Column:
    """The behaviours that a query speaks of; all if it speaks of none."""
    low = F.lower(query)
    hit = F.array_compact(F.array(*[F.when(rules.any_of(low, words), F.lit(name)) for name, words in ASKED.items()]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(*map(F.lit, ASKED)))


def test_functions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, test, word): the distinct identifiers in each test function of the files in a folder of tests."""
    tests = symbols.filter(F.col("type").isin("function", "method") & F.col("name").startswith("test_") & F.col("path").rlike("(?i)test"))
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    rows = tests.join(files.select("path", "text"), "path").select("path", F.col("name").alias("test"), F.array_distinct(F.regexp_extract_all(body, F.lit("\\w+"), F.lit(0))).alias("w"))
    return rows.select("path", "test", F.explode("w").alias("word"))


#: Fixed value: a word of as many rows is left out before a join by word, if nobody asks for it.
OFTEN = 100_000


def _spoken(tests: DataFrame, names: DataFrame) -> DataFrame:
    """``tests`` without frequent words that are none of ``names`` (word): they meet nothing, and a join would gather all rows of each in one task.

    What comes to the driver are at most as many words as ``tests`` has rows by ``OFTEN``.
    """
    often = tests.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    words = [r.word for r in often.join(names, "word", "left_anti").select("word").collect()]
    return tests.filter(~F.col("word").isin(words)) if words else tests


def affected_tests(asked: DataFrame, tests: DataFrame, most: int | None = None) -> DataFrame:
    """(path, name, test) for symbols (path, name): the test functions that speak of them, in a file named after the module or the symbol, or in any that calls it; each once.

    ``tests``: :func:`test_functions`. They meet by words, so no text is searched for every symbol.
    """
    q = asked.select("path", "name").distinct()
    tests = _spoken(tests, q.select(F.col("name").alias("word")))
    hit = q.join(tests.select(F.col("path").alias("from"), "test", F.col("word").alias("name")), "name").select("path", "name", F.concat_ws("::", "from", "test").alias("test")).distinct()
    return hit if most is None else first_n(hit, ["path", "name"], most, F.col("test"))


def candidate_files(asked: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, name, file): test files that speak of a symbol or of its module."""
    module = F.regexp_extract("path", "([^/]+)\\.\\w+$", 1)
    q = asked.select("path", "name").distinct().withColumn("word", F.explode(F.array("name", module)))
    words = _spoken(tests, q.select("word")).select(F.col("path").alias("file"), "word").distinct()
    return q.join(words, "word").select("path", "name", "file").distinct()


#: Fixed value: a name whose callers times the symbols that it stands between are as many is counted by sets, not by pairs.
PAIRS = 1_000_000


def indirect_callers(asked: DataFrame, found: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(path, name, n): how many functions call a symbol (path, name), or a function by the name of one that does, itself left out; none of 0.

    ``found``: distinct (name, path, caller), who calls what by name. A name
    between many callers and many symbols (``run``) would make a row for each
    two of them. Its callers are counted once for all symbols that share such
    names, and of the other callers those that call none of these are added.
    What comes to the driver are such names, at most ``found`` by the root of ``pairs``.
    """
    q = asked.select("path", "name").distinct()
    names = q.select("name").distinct()
    between = names.select("name", F.col("name").alias("mid")).unionByName(names.join(found, "name").select("name", F.col("caller").alias("mid"))).distinct()
    fan = between.groupBy(F.col("mid").alias("name")).agg(F.count(F.lit(1)).alias("_out")).join(found.groupBy("name").agg(F.count(F.lit(1)).alias("_in")), "name")
    often = [r.name for r in fan.filter(F.col("_out") * F.col("_in") >= pairs).select("name").collect()]
    few = between.filter(~F.col("mid").isin(often)).join(found.withColumnRenamed("name", "mid"), "mid").select("name", "path", "caller").distinct()
    if often:
        sets = between.filter(F.col("mid").isin(often)).groupBy("name").agg(F.array_sort(F.collect_list("mid")).alias("_s")).hint("merge")
        theirs = found.filter(F.col("name").isin(often)).groupBy("path", "caller").agg(F.array_sort(F.collect_list("name")).alias("_c")).hint("merge")
        few = few.join(sets, "name", "left").join(theirs, ["path", "caller"], "left").filter(~F.coalesce(F.arrays_overlap("_s", "_c"), F.lit(False)))
        kinds = theirs.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).select("_c", "n", F.explode("_c").alias("mid"))
        met = sets.select("_s").distinct().select("_s", F.explode("_s").alias("mid")).join(kinds, "mid").select("_s", "_c", "n").distinct()
        # All symbols may share a set, so each set is there for each of some parts.
        many = met.groupBy("_s").agg(F.sum("n").alias("n")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(15))))
        many = sets.withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(16)).cast("int")).join(many, ["_s", "_part"]).select("name", "n")
    counted = few.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    counted = (counted.unionByName(many) if often else counted).groupBy("name").agg(F.sum("n").alias("n"))
    own = q.join(found.select("path", F.col("caller").alias("name"), F.col("name").alias("mid")), ["path", "name"]).join(between.hint("merge"), ["name", "mid"]).groupBy("path", "name").agg(F.lit(1).alias("_own")).hint("merge")
    rows = q.join(counted, "name").join(own, ["path", "name"], "left")
    return rows.select("path", "name", (F.col("n") - F.coalesce("_own", F.lit(0))).alias("n")).filter("n > 0")


def impact(asked: DataFrame, direct: DataFrame, transitive: DataFrame, tests: DataFrame) -> DataFrame:
    """Symbols (path, name) with ``callers``, ``indirect``, ``tests``, ``coverage``, ``risk``, ``safe``, ``breaking`` and ``advice``.

    ``direct`` has (name, n), ``transitive`` and ``tests`` (path, name, n).
    Coverage is a test for every three callers, at most 1, and 1 without callers.
    """
    n = lambda df, to: df.withColumnRenamed("n", to)
    rows = asked.select("path", "name").distinct().join(n(direct, "callers"), "name", "left").join(n(transitive, "indirect"), ["path", "name"], "left").join(n(tests, "tests"), ["path", "name"], "left").fillna(0, ["callers", "indirect", "tests"])
    callers, indirect, tested = F.col("callers"), F.col("indirect"), F.col("tests")
    share = F.round(F.least(F.lit(1.0), tested / F.greatest(F.lit(1), F.floor(callers / 3))), 2)
    rows = rows.withColumn("coverage", F.when(callers == 0, 1.0).when(tested == 0, 0.0).otherwise(share))
    cover = F.col("coverage")
    rows = rows.withColumn("risk", sc.impact_risk(callers, indirect, cover)).withColumn("safe", sc.safe_to_modify(F.col("risk"), cover))
    percent = F.concat(F.round(100 * cover).cast("int").cast("string"), F.lit("%"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    low = (cover < 0.5) & (callers > 0)
    breaking = [
        F.when(callers > 0, text("a new signature breaks ", callers.cast("string"), " callers")),
        F.when(indirect > 10, text(indirect.cast("string"), " indirect callers feel it")),
        F.when(low, text("only ", percent, " covered")),
        F.when((tested == 0) & (callers > 5), F.lit("much used and not tested")),
    ]
    advice = [
        F.when(F.col("risk").isin("high", "critical"), F.lit("deprecate before changing the signature")),
        F.when(tested > 0, F.lit("update the tests")).when(callers > 0, F.lit("add tests first")),
        F.when(callers > 10, F.lit("warn callers first")),
        F.when(low, F.lit("cover more")),
    ]
    some = F.array_compact(F.array(*advice))
    return rows.withColumns({"breaking": F.array_compact(F.array(*breaking)), "advice": F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("safe to modify")))})


def touched_symbols(changes: DataFrame, symbols: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, name, type, lines): the symbols that changed lines (keys, path, start, end) touch, and how many of their lines."""
    s = symbols.filter("type != 'file'").select("path", "name", "type", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    both = iv.overlaps(changes.select(*keys, "path", F.col("start").alias("a"), F.col("end").alias("b")), s, "path", ("a", "b"), ("s", "e"))
    return both.groupBy(*keys, "path", "name", "type", "s").agg(F.sum("shared").cast("long").alias("lines")).drop("s")


def branch_report(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(branch, files, symbols, conflicts, risk): per branch its changed files and symbols, the files that another branch changes too, and the risk."""
    files = changes.select("branch", "path").distinct()
    shared = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit(True).alias("shared"))
    per = files.join(shared, "path", "left").groupBy("branch").agg(F.count(F.lit(1)).alias("files"), F.count("shared").alias("conflicts"), F.max(sc.is_critical(F.col("path"))).alias("critical"))
    found = touched_symbols(changes, symbols, ("branch",)).groupBy("branch").agg(F.count(F.lit(1)).alias("symbols"))
    rows = per.join(found, "branch", "left").fillna(0, ["symbols"])
    return rows.select("branch", "files", "symbols", "conflicts", sc.branch_risk(F.col("symbols"), F.col("critical")).alias("risk"))


def branch_overlaps(changes: DataFrame) -> DataFrame:
    """(path, a, b, lines): the lines of a file that two branches both change."""
    a = changes.select("path", F.col("branch").alias("a"), F.col("start").alias("a0"), F.col("end").alias("a1"))
    b = changes.select("path", F.col("branch").alias("b"), F.col("start").alias("b0"), F.col("end").alias("b1"))
    both = iv.overlaps(a, b, "path", ("a0", "a1"), ("b0", "b1")).filter("a < b")
    return both.groupBy("path", "a", "b").agg(F.sum("shared").cast("long").alias("lines"))


def change_set(indexed: DataFrame, present: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, status): files (path, hash) that were added, modified or deleted since they were indexed, and those that are there and not ``tracked``."""
    both = indexed.withColumnRenamed("hash", "_old").join(present.withColumnRenamed("hash", "_new"), "path", "full_outer").join(tracked.select("path", F.lit(True).alias("_t")), "path", "left")
    status = F.when(F.col("_new").isNull(), "deleted").when(F.col("_t").isNull() & F.col("_old").isNull(), "untracked").when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("path", status.alias("status")).filter("status is not null")


def reparse_all(changed: Column, total: Column, share: float = 0.3) -> Column:
    """Whether so much changed that all is parsed again."""
    return (total > 0) & (changed / total > share)


def last_edits(blame: DataFrame) -> DataFrame:
    """(id, author, at, days, authors): per blamed text who edited it last and when, on how many days of the last seven before that, and how many authors it has."""
    last = blame.groupBy("id").agg(F.max("at").alias("_last"))
    rows = blame.join(last, "id")
    recent = F.when(F.col("at") > F.col("_last") - 7 * 86_400, F.floor(F.col("at") / 86_400))
    return rows.groupBy("id").agg(F.max_by("author", F.struct("at", "line")).alias("author"), F.max("at").alias("at"), F.count_distinct(recent).alias("days"), F.count_distinct("author").alias("authors"))


def stack(manifest: Column, language: str) -> Column:
    """The technologies that a manifest speaks of, in order."""
    low = F.lower(manifest)
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(name)) for w, name in STACKS[language].items()]))


# Words of a manifest with what they make of a project, and folders (one group of them) with what they do; the first that fits counts.
PROJECTS = (("fastapi", "FastAPI Application"), ("django", "Django Application"), ("flask", "Flask Application"))
PACKAGED, PLAIN = ("[tool.poetry]", "Python Library"), "Python Project"
SHAPES = (
    ((("server",),), "Server"),
    ((("api", "models"),), "REST API"),
    ((("app", "templates"),), "Web application"),
    ((("cli",), ("cmd",)), "CLI application"),
    ((("web",), ("static",)), "Web application"),
    ((("lib",), ("src",)), "Library with modular components"),
)
SHAPELESS = ("Modular ", " application")
# End of fixed values.


def project_type(manifest: Column) -> Column:
    """What a Python project is by its manifest."""
    named = [F.when(F.lower(manifest).contains(word), name) for word, name in PROJECTS]
    return F.coalesce(*named, F.when(manifest.contains(PACKAGED[0]), PACKAGED[1]), F.lit(PLAIN))


def architecture(folders: Column, language: Column) -> Column:
    """What a project is by the names of its folders."""
    title = F.initcap(language)
    has_all = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), folders)) == 0
    shapes = [F.when(has_all(names), F.concat(F.lit(f"{shape} ("), title, F.lit(")"))) for groups, shape in SHAPES for names in groups]
    return F.coalesce(*shapes, F.concat(F.lit(SHAPELESS[0]), title, F.lit(SHAPELESS[1])))
