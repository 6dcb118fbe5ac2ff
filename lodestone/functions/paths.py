"""Path helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roots of the standard library that are told apart from other packages.
STANDARD = ("os", "sys", "re", "json", "time", "math", "random", "typing", "pathlib", "collections", "itertools", "functools", "datetime", "logging", "subprocess", "threading", "asyncio", "abc", "io", "enum")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*?)(?:\\.[^./]*)?$", 1)


def module(path: Column) -> Column:
    """``a/b/c.py`` as ``a.b.c``; a package's own file is the package."""
    plain = F.regexp_replace(F.regexp_replace(path, "\\.[A-Za-z]+$", ""), "/__init__$", "")
    return F.replace(F.regexp_replace(plain, "^/+|/+$", ""), F.lit("/"), F.lit("."))


def module_path(name: Column, importer: Column) -> Column:
    """Where a module would be; leading dots go up from the importer's folder."""
    dots = F.length(F.regexp_extract(name, "^(\\.*)", 1))
    folder = F.split(F.regexp_replace(importer, "/?[^/]*$", ""), "/")
    base = F.array_join(F.slice(folder, 1, F.greatest(F.lit(0), F.size(folder) - dots + 1)), "/")
    rest = F.replace(F.regexp_replace(name, "^\\.+", ""), F.lit("."), F.lit("/"))
    return F.when(dots == 0, rest).otherwise(F.concat_ws("/", F.when(base != "", base), F.when(rest != "", rest)))


def fits(path: Column, expected: Column) -> Column:
    """The same path but for its suffix, one that ends like it, or one with the same stem."""
    plain = F.regexp_replace(path, "\\.[A-Za-z]+$", "")
    return (plain == expected) | plain.endswith(F.concat(F.lit("/"), expected)) | (stem(path) == stem(expected))


def tail(path: Column, parts: int = 3) -> Column:
    """The last parts of a path."""
    p = F.split(path, "/")
    return F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - parts + 1), parts), "/")


def glob(pattern: str) -> str:
    """A glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c == "/" else "\\" + c), i + 1
    return f"^{out}$"


def dependency(root: Column, own: tuple[str, ...]) -> Column:
    """internal, stdlib or external by a module's first part."""
    return F.when(root.isin(*own), "internal").when(root.isin(*STANDARD), "stdlib").otherwise("external")


def homonym_score(path: Column, name: Column, here: Column) -> Column:
    """How likely a path has the symbol meant: in this folder +100, shallow +50 less its depth, of its name +30, in a source folder +20."""
    depth = F.size(F.split(path, "/"))
    return (
        F.when(path.startswith(here), 100).otherwise(0)
        + F.greatest(F.lit(0), 50 - depth)
        + F.when(F.lower(stem(path)) == F.lower(name), 30).otherwise(0)
        + F.when(path.rlike("(?:^|/)(?:src|lib|pkg|internal)/"), 20).otherwise(0)
    )


#: How names of working notes end, folders that are not watched, suffixes that are, and the largest file.
NOTE_SUFFIXES = ("-GUIDE.md", "-WORKFLOWS.md", "-HANDOFF.md", "-LEADERSHIP.md", "-VPS-OPS.md", "-ARCHITECTURE.md", "-COMMANDS.md", "-DEVELOPMENT.md")
UNWATCHED = ("__pycache__", "node_modules", ".venv", "venv", "env", "build", "dist", ".git", ".idea", ".vscode", "site-packages")
WATCHED = ("py", "ts", "js", "go")
LARGEST = 1 << 20


def is_working_note(path: Column, names: tuple[str, ...] = ("HANDOFF.md", "PROJECT-GUIDE.md")) -> Column:
    """Markdown that is indexed: of these ``names``, of a phase, or by how its name ends."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ends = F.lit(False)
    for suffix in NOTE_SUFFIXES:
        ends = ends | name.endswith(suffix)
    return name.isin(*names) | F.upper(name).rlike("^PHASE[-_]") | ends


def is_watched(path: Column, unwatched: tuple[str, ...] = UNWATCHED) -> Column:
    """A source file in some folder, none of whose folders but the first is left out."""
    inside = "/(?:" + "|".join(n.replace(".", "\\.") for n in unwatched) + ")/"
    return path.rlike("/[^/]*\\.(?:" + "|".join(WATCHED) + ")$") & ~path.rlike(inside)


def is_small(size: Column, largest: int = LARGEST) -> Column:
    return size <= largest


def is_private(name: Column) -> Column:
    """One underscore in front, not two."""
    return name.rlike("^_(?!_)")
