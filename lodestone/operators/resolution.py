"""Names to definitions: bases, types of variables, method calls, overrides. Over facts as tables (see ``sources.code``).

Every lookup is a join by name; of several answers the first strategy's counts,
within one the first by path and line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.relational import priority_first

#: How sure a resolution is.
SURE = {"same_file": 1.0, "imported": 0.95, "external": 0.7, "annotation": 0.9, "instantiation": 0.85, "heuristic": 0.5}


def return_type(signature: Column) -> Column:
    """What a signature returns; null if it does not tell."""
    return F.nullif(F.regexp_extract(signature, "->\\s*(.+)$", 1), F.lit(""))


def parameters(signature: Column) -> Column:
    """Array of (name, annotation) of a signature's annotated parameters."""
    found = F.regexp_extract_all(signature, F.lit("(\\w+): ([\\w.\\[\\]|]+)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^(\\w+)", 1).alias("name"), F.regexp_extract(x, ": (.+)$", 1).alias("annotation")))


def definitions(symbols: DataFrame, kind: str) -> DataFrame:
    """(name, path, start_line): the first symbol of a kind by each name."""
    rows = symbols.filter(F.col("type") == kind).groupBy("name").agg(F.min(F.struct("path", "start_line")).alias("m"))
    return rows.select("name", "m.*")


def resolve_bases(bases: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(path, cls, base, ord, target, confidence): the class that a base names, in the same file, else as imported, else in the same folder or below; null and less sure without one.

    ``links``: (importer, name, path) of resolved imports.
    """
    b = bases.select("path", "cls", "base", "ord")
    classes = symbols.filter("type = 'class'").select(F.col("name").alias("base"), F.col("path").alias("found")).distinct()
    imported = links.filter("path is not null").groupBy(F.col("importer").alias("path"), F.col("name").alias("base")).agg(F.min("path").alias("imported"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    # Classes of a base's name meet it once, and are told apart where they met.
    met = b.join(imported, ["path", "base"], "left").join(classes, "base", "left")
    same, near = F.col("found") == F.col("path"), F.col("found").startswith(F.concat(folder, F.lit("/")))
    found = met.groupBy("path", "cls", "base", "ord", "imported").agg(F.min(F.when(same, F.col("found"))).alias("same"), F.min(F.when(near, F.col("found"))).alias("near"))
    found = found.withColumn("target", F.coalesce("same", "imported", "near"))
    sure = F.when(F.col("target").isNull(), SURE["external"]).when(F.col("target") == F.col("path"), SURE["same_file"]).otherwise(SURE["imported"])
    return found.select("path", "cls", "base", "ord", "target", sure.alias("confidence"))


def module_imports(imports: DataFrame) -> DataFrame:
    """(path, name) of names that are modules, as in ``import os``: the last part of what is imported."""
    rows = imports.select("path", "module", F.explode("names").alias("name"))
    return rows.filter(F.col("name") == F.element_at(F.split("module", "\\."), -1)).select("path", "name").repartition("path").distinct()


def type_map(symbols: DataFrame, imports: DataFrame, types: DataFrame, links: DataFrame) -> DataFrame:
    """(path, name, type, strategy): what each name of a file is.

    In this order: a resolved import (1); an annotation or an instance, of
    several the last (2); ``self``, the class of the file's first method (3); an
    imported name, itself (4); an annotated parameter (5); what the function
    that gives the value returns (6). Names without any are left out.
    """
    rows = lambda df, n, name, told, at, down=None: df.select("path", name.alias("name"), told.alias("told"), F.lit(n).alias("strategy"), at.cast("long").alias("at"), F.lit(down).cast("string").alias("down") if down is None else down.alias("down"))
    name, none = F.col("name"), F.lit(None)
    latest = F.coalesce(-F.col("line").cast("long"), F.lit(2**31))
    named = imports.select("path", F.explode("names").alias("name"))
    functions = symbols.filter(F.col("type").isin("function", "method"))
    args = functions.select("path", "start_line", F.explode(parameters(F.col("signature"))).alias("p")).filter("p.name != 'self'")
    gives = symbols.filter("type = 'function'").select(F.col("name").alias("annotation"), "path", "start_line", return_type(F.col("signature")).alias("r")).filter("r is not null")
    gives = gives.groupBy("annotation").agg(F.min_by("r", F.struct("path", "start_line")).alias("r"))
    parts = [
        rows(links.filter("path is not null").select(F.col("importer").alias("path"), "name"), 1, name, name, none),
        rows(types.filter(F.col("how") != "call"), 2, name, F.col("annotation"), latest, F.col("annotation")),
        rows(symbols.filter("type = 'method' and parent is not null"), 3, F.lit("self"), F.col("parent"), F.col("start_line")),
        rows(named, 4, name, name, none),
        rows(args, 5, F.col("p.name"), F.col("p.annotation"), F.col("start_line")),
        rows(types.filter("how = 'call'").join(gives, "annotation"), 6, name, F.col("r"), F.col("line")),
    ]
    # All that is told of a file's names is dealt out once, by path, and ordered once.
    told = reduce(DataFrame.unionByName, parts).repartition("path")
    w = Window.partitionBy("path", "name").orderBy("strategy", "at", F.desc("down"), "told")
    out = told.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    kind = F.when(F.col("strategy").isin(2, 5, 6), tx.base_type(F.col("told"))).otherwise(F.col("told"))
    return out.select("path", "name", kind.alias("type"), "strategy")


def resolve_calls(calls: DataFrame, symbols: DataFrame, kinds: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, line, receiver, callee, target, cls, confidence, how) of the method calls whose receiver's type is known.

    A chained receiver has the type of its first part if it has none itself. A
    type that is a class gives the class's method, else the class; a name that
    is a module gives the module. ``kinds``: :func:`type_map`; ``modules``: :func:`module_imports`.
    """
    asked = calls.filter("receiver is not null and path is not null").select("path", "line", "receiver", "callee").repartition("path").distinct()
    # A file's names as a map, so that its calls are dealt out by path and no more.
    own = kinds.filter("path is not null and name is not null").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("kinds"))
    module = modules.filter("path is not null").groupBy("path").agg(F.collect_set("name").alias("modules"))
    rows = asked.join(own, "path").join(module, "path", "left")
    kind = lambda c: F.try_element_at("kinds", c)
    first = F.regexp_extract("receiver", "^(\\w+)", 1)
    rows = rows.select("path", "line", "receiver", "callee", F.coalesce(kind(F.col("receiver")), kind(first)).alias("cls"), F.array_contains("modules", F.col("receiver")).alias("module")).filter("cls is not null")
    classes = definitions(symbols, "class").select(F.col("name").alias("cls"), F.col("path").alias("class_path"))
    methods = symbols.filter("type = 'method'").groupBy(F.col("parent").alias("cls"), F.col("name").alias("callee")).agg(F.min("path").alias("method_path"))
    rows = rows.join(classes, "cls", "left").join(methods, ["cls", "callee"], "left")
    is_class, is_module = F.col("class_path").isNotNull(), F.coalesce("module", F.lit(False))
    found = rows.filter(is_class | is_module)
    sure = is_class & F.col("method_path").isNotNull()
    how = F.when(sure, "type_annotation").when(is_class, "heuristic").otherwise("module_import")
    target = F.when(sure, F.col("method_path")).when(is_class, F.col("class_path"))
    return found.select("path", "line", "receiver", "callee", target.alias("target"), "cls", F.when(sure, SURE["annotation"]).otherwise(SURE["heuristic"]).alias("confidence"), how.alias("how"))


def instances(types: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, name, cls, target, confidence): variables made by calling a class that there is."""
    made = types.filter("how = 'instance'").select("path", "line", "name", tx.base_type(F.col("annotation")).alias("cls"))
    classes = definitions(symbols, "class").select(F.col("name").alias("cls"), F.col("path").alias("target"))
    return made.join(classes, "cls").select("path", "line", "name", "cls", "target", F.lit(SURE["instantiation"]).alias("confidence"))


def variable_types(asked: DataFrame, types: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(path, name, type, confidence, how) for (path, name): by annotation, else by instantiation, else by what an imported name is; null without any."""
    q = asked.select("path", "name").distinct().hint("merge")  # never gathered on the driver, however small Spark takes them to be
    last = lambda how: types.filter(F.col("how") == how).groupBy("path", "name").agg(F.max_by("annotation", F.struct("line", "annotation")).alias("type"))
    kinds = symbols.groupBy("path", "name").agg(F.min_by("type", F.struct("start_line", "type")).alias("type"))
    imported = links.filter("path is not null").select("importer", "name", "path").join(kinds, ["path", "name"]).select(F.col("importer").alias("path"), "name", "type")
    put = lambda df, how, c: q.join(df, ["path", "name"]).select("path", "name", "type", F.lit(c).alias("confidence"), F.lit(how).alias("how"))
    none = q.select("path", "name", F.lit(None).cast("string").alias("type"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("how"))
    parts = [put(last("annotation"), "annotation", SURE["annotation"]), put(last("instance"), "instantiation", SURE["instantiation"]), put(imported, "import", SURE["imported"]), none]
    return priority_first(parts, ["path", "name"], "type").drop("strategy")


def lookup_types(asked: DataFrame, types: DataFrame) -> DataFrame:
    """(path, name, type, own): the last type that a name has in the file, else the first that it has in any other by path; null without one."""
    q = asked.select("path", "name").distinct()
    here = types.groupBy("path", "name").agg(F.max_by("annotation", F.struct("line", "annotation")).alias("here"))
    any_ = types.groupBy("name").agg(F.min_by("annotation", F.struct("path", "line", "annotation")).alias("any"))
    return q.join(here, ["path", "name"], "left").join(any_, "name", "left").select("path", "name", F.coalesce("here", "any").alias("type"), F.col("here").isNotNull().alias("own"))


def overridden(symbols: DataFrame, order: DataFrame) -> DataFrame:
    """(cls, method, base, position, confidence): methods of a class that one of those it inherits from has too; ``order`` as of ``graph.linearised``."""
    methods = symbols.filter("type = 'method'").select(F.col("parent").alias("cls"), F.col("name").alias("method")).distinct()
    above = methods.withColumnRenamed("cls", "base")
    return methods.join(order, "cls").join(above, ["base", "method"]).select("cls", "method", "base", "position", "confidence")


def typed_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(callee, calls, typed, pairs): calls by name, definitions by that name that tell what they return, and how many pairs these make; counted on either side before they meet."""
    typed = symbols.filter(F.col("type").isin("function", "method") & return_type(F.col("signature")).isNotNull())
    d = typed.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("typed"))
    n = calls.groupBy("callee").agg(F.count(F.lit(1)).alias("calls"))
    return n.join(d, "callee").select("callee", "calls", "typed", (F.col("calls") * F.col("typed")).alias("pairs"))


def callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, callee, caller): each call with the function or method around it that begins last."""
    from lodestone.operators import intervals as iv

    functions = symbols.filter(F.col("type").isin("function", "method")).select("path", "name", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    points = calls.select("path", F.col("line").alias("at"), "callee").distinct().withColumn("point", F.struct("path", "at", "callee"))
    got = iv.latest_start(points, functions, "path", "point", "name")
    return got.select("point.path", F.col("point.at").alias("line"), "point.callee", F.col("name").alias("caller"))


def dependencies(asked: DataFrame, symbols: DataFrame, calls: DataFrame, links: DataFrame) -> DataFrame:
    """(path, name, kind, other) for the symbols asked for: who calls them by name, whom they call, and what their file imports; each once."""
    q, found = asked.select("path", "name").distinct(), callers(calls, symbols)
    who = found.select(F.col("callee").alias("name"), F.concat_ws(":", "path", "caller").alias("other")).join(q, "name").select("path", "name", F.lit("caller").alias("kind"), "other")
    whom = found.select("path", F.col("caller").alias("name"), F.col("callee").alias("other")).join(q, ["path", "name"]).select("path", "name", F.lit("callee").alias("kind"), "other")
    names = links.select(F.col("importer").alias("path"), F.col("name").alias("other")).join(q, "path").select("path", "name", F.lit("import").alias("kind"), "other")
    return who.unionByName(whom).unionByName(names).distinct()


def package_tree(symbols: DataFrame) -> DataFrame:
    """(folder, files, symbols, lines, largest): per folder with all below it, its files, their symbols and lines, and the longest file's path."""
    per = symbols.groupBy("path").agg(F.count_if(F.col("type") != "file").alias("symbols"), F.max("end_line").cast("long").alias("lines"))
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder")
    rows = per.filter(F.size(F.split("path", "/")) > 1).select("*", above)
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"), F.sum("lines").alias("lines"), F.min_by("path", F.struct(-F.col("lines"), F.col("path"))).alias("largest"))
