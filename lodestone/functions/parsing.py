"""Source texts to facts: symbols, imports, calls, types, diffs. Each function works on one text."""

from __future__ import annotations

import ast
import functools
import hashlib
import re

#: Suffix to language; of those in PLAIN only the file itself is a symbol.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "md": "markdown"}
PLAIN = {"rst": "rst", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "sh": "shell", "bash": "shell"}
#: Per language the definitions that one line shows: (kind, pattern with the name in group 1).
PATTERNS = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)")],
    "typescript": [
        ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
        ("variable", r"^\s*(?:export\s+)?const\s+(\w+)\s*[:=]"),
    ],
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)")],
    "go": [("struct", r"^\s*type\s+(\w+)\s+struct\b"), ("interface", r"^\s*type\s+(\w+)\s+interface\b"), ("function", r"^func\s+(\w+)\s*\("), ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\(")],
}
SYMBOL = "name string, type string, start_line int, end_line int, signature string, parent string"


def language(path: str) -> str | None:
    """The language of a path's suffix; None for those without symbols."""
    return LANGUAGES.get(path.rpartition(".")[2].lower())


def known(path: str) -> bool:
    """Whether a path's suffix is one that an index holds."""
    return path.rpartition(".")[2].lower() in LANGUAGES | PLAIN


def symbols(path: str, text: str) -> list[tuple]:
    """(name, type, first line, last line, signature, parent) of a file: itself first, then what it defines."""
    lines = text.count("\n") + 1
    stem = path.rpartition("/")[2].rpartition(".")[0] or path
    out = [(stem, "file", 1, lines, None, None)]
    kind = language(path)
    if kind == "python":
        return out + _python(text)
    if kind == "markdown":
        return out + [(t, "section", a, b, None, None) for t, _, a, b in sections(text)]
    return out + (_by_line(kind, text) if kind else [])


@functools.lru_cache(maxsize=1)
def _tree(text: str) -> ast.Module | None:
    """A Python text's tree, None where it does not parse; kept for the next to ask about the same text, so nobody may change it."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """A function's parameters and what it returns, as ``ast.unparse`` writes them; plain ones without it, as it takes as long as parsing."""
    a, back = node.args, node.returns
    plain = not (a.posonlyargs or a.vararg or a.kwonlyargs or a.kwarg) and all(x.annotation is None or isinstance(x.annotation, ast.Name) for x in a.args)
    if plain and all(isinstance(x, ast.Constant) and (x.value is None or isinstance(x.value, bool)) for x in a.defaults):
        given = [""] * (len(a.args) - len(a.defaults)) + [f"={x.value}" for x in a.defaults]
        args = ", ".join(f"{x.arg}: {x.annotation.id}{g}" if x.annotation else x.arg + g for x, g in zip(a.args, given, strict=True))
    else:
        args = ast.unparse(a)
    return f"({args})" + (f" -> {back.id if isinstance(back, ast.Name) else ast.unparse(back)}" if back else "")


def _python(text: str) -> list[tuple]:
    tree = _tree(text)
    if tree is None:
        return _by_line("python", text)
    out = []

    def visit(body: list, parent: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                out.append((node.name, "class", node.lineno, node.end_lineno, None, parent))
                visit(node.body, node.name)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append((node.name, "method" if parent else "function", node.lineno, node.end_lineno, _signature(node), parent))

    visit(tree.body, None)
    return out


_PARTS = ("body", "orelse", "finalbody", "handlers", "cases")


def _statements(tree: ast.AST) -> list[ast.AST]:
    """A tree's statements, however deep; what defines something is one, so expressions are not looked at."""
    out = [tree]
    for node in out:  # grows on the way
        for part in _PARTS:
            out += getattr(node, part, ())
    return out


def _by_line(kind: str, text: str) -> list[tuple]:
    out = []
    rows = text.split("\n")
    for i, row in enumerate(rows, 1):
        for what, pattern in PATTERNS[kind]:
            if m := re.match(pattern, row):
                end, parent = i, None
                if kind in ("go", "rust") and "{" in "\n".join(rows[i - 1 : i + 3]):
                    end = i + block(rows[i - 1 :])
                if what == "method" and (r := re.match(r"^func\s+\(\s*\w*\s*\*?(\w+)", row)):
                    parent = r[1]
                out.append((m[1], what, i, end, None, parent))
                break
    return out


def block(rows: list[str]) -> int:
    """How many lines after the first the block that opens there closes; strings and comments hold no braces. A declaration ends with its semicolon."""
    depth, quote, comment = 0, "", False
    for n, row in enumerate(rows):
        i = 0
        while i < len(row):
            two, c = row[i : i + 2], row[i]
            if comment:
                comment = two != "*/"
                i += 1 if comment else 2
                continue
            if quote:
                if c == "\\" and quote != "`":
                    i += 1
                elif c == quote:
                    quote = ""
            elif two == "//":
                break
            elif two == "/*":
                comment = True
                i += 1
            elif c in "\"'`":
                quote = c
            elif c == ";" and not depth:
                return n
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth <= 0 and c == "}":
                    return n
            i += 1
        if quote != "`":
            quote = ""
    return max(0, len(rows) - 1)


def sections(text: str) -> list[tuple[str, int, int, int]]:
    """(title, level, first line, last line) of Markdown headings outside of code fences; a section ends before the next heading."""
    heads, fence = [], False
    rows = text.split("\n")
    for i, row in enumerate(rows, 1):
        if row.startswith("```"):
            fence = not fence
        elif not fence and (m := re.match(r"(#{1,6})\s+(.*\S)", row)):
            heads.append((m[2], len(m[1]), i))
    ends = [h[2] - 1 for h in heads[1:]] + [len(rows)]
    return [(t, n, a, b) for (t, n, a), b in zip(heads, ends, strict=True)]


def imports(path: str, text: str) -> list[tuple[str, list[str], int]]:
    """(module, names without aliases, line) of each import."""
    out = []
    kind = language(path)
    names = lambda s: [x.split(" as ")[0].strip() for x in s.strip("(){} ").split(",") if x.strip()]
    for i, row in enumerate(text.split("\n"), 1):
        if kind == "python":
            if "import" not in row:
                continue
            if m := re.match(r"\s*from\s+([.\w]+)\s+import\s+(.+)", row):
                out.append((m[1], names(m[2].split("#")[0]), i))
            elif m := re.match(r"\s*import\s+([\w., ]+)", row):
                out += [(x, [x.rpartition(".")[2]], i) for x in names(m[1])]
        elif kind in ("javascript", "typescript"):
            if m := re.match(r"\s*import\s+(?:type\s+)?(.*?)\s*from\s*['\"]([^'\"]+)", row):
                out.append((m[2], names(re.sub(r"[{}]", "", m[1])), i))
            elif m := re.search(r"(?:import|require)\s*\(?\s*['\"]([^'\"]+)", row):
                out.append((m[1], [], i))
        elif kind == "go" and (m := re.match(r'\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$', row)):
            out.append((m[1], [m[1].rpartition("/")[2]], i))
        elif kind == "rust" and (m := re.match(r"\s*(?:pub\s+)?use\s+(\w+(?:::\w+)*)(?:::\{([^}]*)\})?", row)):
            out.append((m[1], names(m[2]) if m[2] else [m[1].rpartition("::")[2]], i))
    return out


_DEFINES = re.compile(r"^\s*(?:(?:(?:export|default|async|pub|public|static)\s+)*(?:def|class|func|fn|function)\b|(?:import|from)\b|#|//)")
_CALL = re.compile(r"((?:\w+\.)+)?(\w+)\s*\(")
_KEYWORDS = {"if", "for", "while", "return", "elif", "switch", "catch", "and", "or", "not", "in", "with", "print", "lambda", "assert", "yield", "except"}


def calls(text: str) -> list[tuple[str | None, str, int]]:
    """(receiver or None, name, line) of each ``name(`` on lines that define nothing."""
    out = []
    for i, row in enumerate(text.split("\n"), 1):
        if "(" in row and not _DEFINES.match(row):
            out += [(m[1][:-1] if m[1] else None, m[2], i) for m in _CALL.finditer(row) if m[2] not in _KEYWORDS]
    return out


#: By language what tells of types: a text that the line has to hold, a pattern with name and type, and how it tells; the first that fits counts.
_TYPES = {
    kind: [(needs, re.compile(pattern), how) for needs, pattern, how in rules]
    for kind, rules in {
        "python": (("->", r"\s*(?:async\s+)?def\s+(\w+)\s*\(.*\)\s*->\s*([^:]+):", "return"), (":", r"\s*(\w+)\s*:\s*([\w\[\]., |]+?)\s*(?:=|$)", "annotation"), ("=", r"\s*(\w+)\s*=\s*([A-Z]\w*)\s*\(", "instance"), ("=", r"\s*(\w+)\s*=\s*([a-z_]\w*)\s*\(", "call")),
        "typescript": (("function", r".*?\bfunction\s+(\w+)\s*\(.*\)\s*:\s*([^{]+?)\s*\{", "return"), (":", r"\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*:\s*([^=;]+?)\s*[=;]", "annotation"), ("new", r"\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*new\s+(\w+)", "instance")),
        "go": (("func", r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*\([^)]*\)\s*([\w.*\[\]]+)\s*\{", "return"), ("var", r"\s*var\s+(\w+)\s+([\w.*\[\]]+)", "annotation"), (":=", r"\s*(\w+)\s*:=\s*&?([A-Z]\w*)\s*\{", "instance")),
    }.items()
}


def types(path: str, text: str) -> list[tuple[str, str, str, int]]:
    """(name, annotation, how, line): return and variable annotations, what is made by calling a class, and in Python what a function gives."""
    out = []
    kind = language(path)
    for i, row in enumerate(text.split("\n"), 1):
        for needs, pattern, how in _TYPES.get(kind, ()):
            if needs in row and (m := pattern.match(row)):
                out.append((m[1], m[2].strip(), how, i))
                break
    return out


def bases(path: str, text: str) -> list[tuple[str, str, int]]:
    """(class, base, place among its bases)."""
    kind = language(path)
    if kind == "python":
        tree = _tree(text)
        if tree is None:
            return []
        return [(n.name, b.id if isinstance(b, ast.Name) else ast.unparse(b), i) for n in _statements(tree) if isinstance(n, ast.ClassDef) for i, b in enumerate(n.bases)]
    if kind in ("javascript", "typescript"):
        found = re.finditer(r"\bclass\s+(\w+)(?:<[^>{]*>)?(?:\s+extends\s+([\w.]+))?(?:<[^>{]*>)?(?:\s+implements\s+([\w., ]+))?", text)
        return [(m[1], b.strip(), i) for m in found for i, b in enumerate(x for x in [m[2], *(m[3] or "").split(",")] if x and x.strip())]
    return []


def base_imports(path: str, text: str) -> list[tuple[str, list[str], int]]:
    """:func:`imports` with only the names that a class of the file extends."""
    wanted = {base for _, base, _ in bases(path, text)}
    kept = [(module, [n for n in names if n in wanted], line) for module, names, line in imports(path, text)] if wanted else []
    return [row for row in kept if row[1]]


def skeleton(text: str, keep: frozenset[str] = frozenset(), least: int = 3) -> str:
    """A Python text with bodies of ``least`` lines or more as ``...``; docstrings and the functions in ``keep`` stay. Broken texts come back as they are."""
    tree = _tree(text)
    if tree is None:
        return text
    rows, out, at = text.split("\n"), [], 0
    for node in sorted((n for n in _statements(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)), key=lambda n: n.lineno):
        body = node.body[1:] if ast.get_docstring(node) is not None else node.body
        if node.name in keep or not body or body[0].lineno - 1 < at or node.end_lineno - body[0].lineno + 1 < least or body[0].lineno == node.lineno:
            continue
        out += rows[at : body[0].lineno - 1] + [" " * body[0].col_offset + "..."]
        at = node.end_lineno
    return "\n".join(out + rows[at:])


def shape(text: str) -> str | None:
    """A hash that stays when only comments, layout and docstrings change; None for texts that do not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    for n in _statements(tree):
        if hasattr(n, "body"):
            n.body = _meant(n)
    return hashlib.md5(ast.dump(tree).encode()).hexdigest()


def same(before: str, after: str) -> bool | None:
    """Whether two texts have the same :func:`shape`; None where one does not parse.

    Statements that are written alike are not looked into, as a dump of a whole
    tree takes longer than parsing it.
    """
    a, b = _tree(before), _tree(after)
    if a is None or b is None:
        return None
    rows = None if "\r" in before or "\r" in after else (before.split("\n"), after.split("\n"))  # Python ends lines there too
    pairs = [(a, b)]
    for x, y in pairs:  # grows on the way
        if type(x) is not type(y):
            return False
        if rows and _written(x, rows[0]) == _written(y, rows[1]) is not None:
            continue
        for field in x._fields:
            v, w = getattr(x, field, None), getattr(y, field, None)
            if field in _PARTS:
                v, w = (_meant(x), _meant(y)) if field == "body" else (v, w)
                if len(v) != len(w):
                    return False
                pairs += zip(v, w, strict=True)
            elif _dump(v) != _dump(w):
                return False
    return True


def _written(node: ast.AST, rows: list[str]) -> tuple | None:
    """The lines of a statement and where it begins and ends in them; None for what has no place or is more than that, as decorators stand before."""
    if getattr(node, "lineno", None) is None or getattr(node, "decorator_list", None):
        return None
    return node.col_offset, node.end_col_offset, rows[node.lineno - 1 : node.end_lineno]


def _meant(node: ast.AST) -> list[ast.AST]:
    """A node's body without its docstring."""
    if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) and ast.get_docstring(node, clean=False) is not None:
        return node.body[1:] or [ast.Pass()]
    return node.body


def _dump(value: object) -> object:
    return [_dump(x) for x in value] if isinstance(value, list) else ast.dump(value) if isinstance(value, ast.AST) else repr(value)


def documented(text: str) -> list[tuple[str, bool, bool]]:
    """(function, has a docstring, has annotations) of a Python text."""
    tree = _tree(text)
    if tree is None:
        return []
    defs = (n for n in _statements(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))
    return [(n.name, ast.get_docstring(n) is not None, n.returns is not None or any(a.annotation for a in n.args.args)) for n in defs]


def diff_ranges(diff: str) -> list[tuple[str, str, int | None, int | None, str | None]]:
    """(path, status, first line, last line, change) of a unified diff: a row per hunk, one without lines for files without hunks."""
    out = []
    for part in re.split(r"(?m)^diff --git ", diff)[1:]:
        path = re.match(r"a/\S+ b/(\S+)", part)
        status = "added" if re.search(r"(?m)^new file", part) else "deleted" if re.search(r"(?m)^deleted file", part) else "modified"
        hunks = re.findall(r"(?m)^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", part)
        for old, start, new in hunks:
            a, b = int(old or 1), int(new or 1)
            out.append((path[1], status, int(start), int(start) + max(b, 1) - 1, "added" if not a else "deleted" if not b else "modified"))
        if not hunks:
            out.append((path[1], status, None, None, None))
    return out


def porter_like(word: str) -> str:
    """Strips common endings for matching words of one stem."""
    for end, least in (("ational", 3), ("ization", 3), ("fulness", 3), ("ing", 3), ("edly", 3), ("ed", 3), ("ies", 2), ("es", 3), ("s", 3), ("ly", 3)):
        if word.endswith(end) and len(word) - len(end) >= least and not word.endswith("ss"):
            return word[: -len(end)] + ("y" if end == "ies" else "")
    return word


def blame(porcelain: str) -> list[tuple[int, str | None, str | None, str | None]]:
    """(line, commit, author, seconds since 1970 as text) of ``git blame --porcelain``; a commit's head is only told once."""
    out, about, commit, line = [], {}, None, 0
    for row in porcelain.split("\n"):
        if m := re.match(r"([0-9a-f]{7,40}) \d+ (\d+)", row):
            commit, line = m[1], int(m[2])
            about.setdefault(commit, {})
        elif row.startswith("author "):
            about[commit]["author"] = row[7:]
        elif row.startswith("author-time "):
            about[commit]["time"] = row[12:]
        elif row.startswith("\t") and commit:
            out.append((line, commit, about[commit].get("author"), about[commit].get("time")))
    return out


def name_status(text: str) -> list[tuple[str, str, str | None]]:
    """(status letter, path, old path of renames) of ``git diff --name-status``."""
    out = []
    for row in text.split("\n"):
        parts = row.split("\t")
        if len(parts) >= 2 and parts[0][:1] in "AMDR" and parts[0]:
            out.append((parts[0][0], parts[-1], parts[1] if parts[0][0] == "R" and len(parts) > 2 else None))
    return out


def script_skeleton(text: str, least: int = 3) -> str:
    """A JavaScript or TypeScript text with the bodies of functions and methods of ``least`` lines or more as ``...``."""
    rows, out, i = text.split("\n"), [], 0
    opens = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\b|(?!(?:if|for|while|switch|catch|class)\b)\w+\s*\([^)]*\)\s*(?::\s*[^{]+)?\{\s*$)")
    while i < len(rows):
        out.append(rows[i])
        if opens.match(rows[i]) and rows[i].rstrip().endswith("{"):
            n = block(rows[i:])
            if n - 1 >= least:
                out.append(" " * (len(rows[i]) - len(rows[i].lstrip()) + 2) + "...")
                i += n
                continue
        i += 1
    return "\n".join(out)


def summary(text: str, within: int = 20) -> str:
    """The first comment line of a source text's first lines, else how long it is."""
    rows = text.split("\n")
    for row in rows[:within]:
        if m := re.match(r"\s*(?:#+(?!!)|//+|/\*+|\"\"\")\s*(.*?\w.*?)\s*(?:\*/|\"\"\")?\s*$", row):
            return m[1]
    return f"Code file with {len(rows)} lines"


def valid(path: str, text: str) -> bool | None:
    """Whether a Python text parses, or the brackets of a script are balanced outside of strings and comments; None for other files."""
    kind = language(path)
    if kind == "python":
        return _tree(text) is not None
    if kind not in ("javascript", "typescript"):
        return None
    plain = re.sub(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", "", text, flags=re.S)
    open_, pairs = [], {")": "(", "]": "[", "}": "{"}
    for c in plain:
        if c in "([{":
            open_.append(c)
        elif c in pairs and (not open_ or open_.pop() != pairs[c]):
            return False
    return not open_
