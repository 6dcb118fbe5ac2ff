"""A source tree made from the driver's tables, for the queries over code: a file of text per row, by a template of its language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import dealt, table

PYTHON = (
    '"""Part {k}."""\n'
    "import os\n"
    "from typing import Optional, List as Many\n"
    "from src.g{h}.m{p} import C{p}, make{p}\n"
    "\n"
    "\n"
    "class C{k}({base}):\n"
    "    {first}\n"
    "\n"
    "    def run(self, n: int) -> int:\n"
    '        """Runs."""\n'
    "        if n > {s} and n:\n"
    "            return self.step{j}(n)\n"
    "        return make{p}(n)\n"
    "\n"
    "    def step{j}(self, n):\n"
    "        total = 0\n"
    "        for i in range(n):\n"
    "            total += i\n"
    "        return total\n"
    "\n"
    "\n"
    "def make{k}(n: int, flag=False) -> C{k}:\n"
    "    item: C{p} = C{p}()\n"
    "    other = C{k}()\n"
    '    print(os.getcwd(), os.path.join("a", "b"))\n'
    "    third = make{p}(n)\n"
    "    return other.run(n){broken}"
)
SCRIPT = (
    "import Base, {{ helper as h{k} }} from './s{p}';\n"
    "const lib = require('lib{k}');\n"
    "\n"
    "export default class W{k} extends W{p} {{\n"
    "  go(x) {{ return h{k}(x); }}\n"
    "}}\n"
    "export async function load{k}(x) {{\n"
    "  // loads {k}\n"
    "  const y = x + {k};\n"
    "  return lib.fetch.all(y);\n"
    "}}\n"
    "function* gen{k}() {{}}"
)
TYPED = (
    'import type {{ A{k} }} from "./a{k}";\n'
    "export interface I{k} {{\n"
    "  id: number;\n"
    "}}\n"
    "export enum E{k} {{ X, Y }}\n"
    "export abstract class D{k}<T> extends B{k} implements I{k}, J {{\n"
    "}}\n"
    "export function conv{k}(x: number): string {{\n"
    "  const item: D{k} = new D{k}();\n"
    "  let made = new Maker{k}(x);\n"
    "  return String(x);\n"
    "}}\n"
    "export const limit{k}: number = {p};"
)
GO = (
    "package svc\n"
    "\n"
    'import "fmt{k}/io"\n'
    "\n"
    "type S{k} struct {{\n"
    "\tname string // {{\n"
    "}}\n"
    "\n"
    "func (s *S{k}) Name{k}(x int) string {{\n"
    '\tif x > 0 {{ return "}}" }}\n'
    "\treturn s.name\n"
    "}}\n"
    "\n"
    "func New{k}() *S{k} {{\n"
    "\tv := &S{k}{{}}\n"
    "\tvar n int\n"
    "\treturn v.init(n)\n"
    "}}"
)
RUST = (
    "use std::collections::{{HashMap, HashSet as Set}};\n"
    "pub struct P{k} {{ x: i32 }}\n"
    "pub enum K{k} {{ A }}\n"
    "pub trait T{k} {{\n"
    "    fn go(&self);\n"
    "}}\n"
    "impl T{k} for P{k} {{\n"
    "    fn go(&self) {{}}\n"
    "}}"
)
NOTES = "# Title {k}\ntext\n```\n# not a heading\n```\n## Part {k}\nend"
PLAIN = "key: {k}\nlist: [1, 2]"


def fill(template: str, **values: Column) -> Column:
    """A template's text, each name in braces replaced by its value; doubled braces are braces."""
    parts = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal.replace("{{", "{").replace("}}", "}")))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def fill_sql(template: str, **values: str) -> str:
    """The same text as an SQL expression, of expressions."""
    parts = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})*)(?:\{(\w+)\})?", template):
        if literal:
            plain = literal.replace("{{", "{").replace("}}", "}").replace("'", "''")
            parts.append("'" + plain.replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'") + "'")
        if name:
            parts.append(f"({values[name]})::VARCHAR")
    return "||".join(parts)


def _rows(spark, d, name: str, key: str) -> tuple[DataFrame, dict[str, Column]]:
    k = F.col(key).cast("long") + 1  # from 1 on
    return dealt(table(spark, d, name), key), {"k": k, "p": k - 1, "h": F.floor((k - 1) / 50)}


def python_files(spark, d) -> DataFrame:
    """(path, text): a module per part, whose class extends that of the part before, every fourth another one; every eleventh does not parse."""
    rows, v = _rows(spark, d, "part", "p_partkey")
    k = v["k"]
    first = F.when(k % 2 == 0, F.concat(F.lit('"""Holds '), F.col("p_size").cast("string"), F.lit('."""'))).otherwise(F.concat(F.lit("size = "), F.col("p_size").cast("string")))
    v |= {"base": F.when(k % 4 == 0, F.lit("Base")).otherwise(F.concat(F.lit("C"), (k - 1).cast("string"))), "s": F.col("p_size"), "j": k % 7, "first": first, "broken": F.when(k % 11 == 0, F.lit("\ndef broken(:")).otherwise("")}
    return rows.select(F.concat(F.lit("src/g"), F.floor(k / 50).cast("string"), F.lit("/m"), k.cast("string"), F.lit(".py")).alias("path"), fill(PYTHON, **v).alias("text"))


def _one(spark, d, name: str, key: str, folder: str, suffix: str, template: str) -> DataFrame:
    rows, v = _rows(spark, d, name, key)
    return rows.select(F.concat(F.lit(folder), v["k"].cast("string"), F.lit(suffix)).alias("path"), fill(template, **v).alias("text"))


def script_files(spark, d) -> DataFrame:
    """(path, text): a JavaScript and a TypeScript module per supplier."""
    return _one(spark, d, "supplier", "s_suppkey", "web/s", ".js", SCRIPT).union(_one(spark, d, "supplier", "s_suppkey", "web/t", ".ts", TYPED))


def compiled_files(spark, d) -> DataFrame:
    """(path, text): a Go file per supplier and a Rust file per nation."""
    return _one(spark, d, "supplier", "s_suppkey", "svc/g", ".go", GO).union(_one(spark, d, "nation", "n_nationkey", "core/r", ".rs", RUST))


def note_files(spark, d) -> DataFrame:
    """(path, text): a Markdown and a YAML file per nation."""
    return _one(spark, d, "nation", "n_nationkey", "docs/n", ".md", NOTES).union(_one(spark, d, "nation", "n_nationkey", "conf/c", ".yaml", PLAIN))


def all_files(spark, d) -> DataFrame:
    return python_files(spark, d).union(script_files(spark, d)).union(compiled_files(spark, d)).union(note_files(spark, d))
