"""Rules that turn corrections and commits into memories, as Column expressions. Word lists and patterns are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.turns import any_of, starts_with_any

LANGUAGES = {
    "go": ("panic", "goroutine", "defer", "chan", "go func", "go mod", "golang"),
    "python": ("except", "async def", "import", "def ", "__init__", "pytest", "pip"),
    "typescript": ("interface", "type ", "promise", "tsx", "namespace", "enum"),
    "javascript": ("const ", "let ", "function", "=>", "async", "npm"),
    "rust": ("unsafe", "unwrap", "borrow", "impl", "fn ", "mut", "cargo"),
}
PROJECT = ("this project", "here", "our", "we use", "portal", "component", "module", "service", "endpoint")
STARTERS = ("use", "keep", "avoid", "never", "always", "prefer", "write", "split", "plan", "test", "log", "limit", "make", "ensure", "check", "validate", "handle")
REWRITES = (
    ("(?i)^don'?t\\s+", "Avoid "),
    ("(?i)^stop\\s+", "Avoid "),
    ("(?i)^be\\s+(concise|terse|short|brief)", "Keep output $1"),
    ("(?i)(.+)\\s+is\\s+bad", "Avoid $1"),
    ("(?i)(.+)\\s+is\\s+good", "Prefer $1"),
    ("(?i)^i\\s+want\\s+", ""),
    ("(?i)^you\\s+should\\s+", ""),
    ("(?i)^make\\s+sure\\s+to\\s+", ""),
)
#: Mode: (indicators, indicators of scope, of urgency).
MODES = {
    "prototype": (("quick", "hack", "try", "prototype", "poc", "draft", "experiment", "see if", "just want to"), ("single file", "< 100 lines", "temporary"), ("5 min", "quick", "fast")),
    "production": (("production", "prod", "deploy", "release", "ship", "launch", "production-ready", "stable", "customer-facing"), ("multiple files", "feature", "system"), ("proper", "complete", "thorough")),
    "hotfix": (("hotfix", "urgent", "critical", "bug", "fix", "broken", "down", "asap", "immediately", "emergency"), ("specific function", "single issue", "targeted"), ("urgent", "now", "asap", "immediately")),
    "refactor": (("refactor", "cleanup", "improve", "restructure", "organize", "simplify", "optimize", "technical debt"), ("existing code", "no new features"), ("careful", "thorough")),
    "audit": (("review", "audit", "analyze", "understand", "explain", "how does", "what does", "walk me through"), ("read-only", "no changes"), ()),
    "exploration": (("explore", "find", "search", "locate", "where is", "list", "what files"), ("codebase", "project structure"), ()),
}


def scope(text: Column, project: str | None = None) -> Column:
    """The first language whose words the text has, else the project if it speaks of one, else universal."""
    low = F.lower(text)
    out = None
    for name, words in LANGUAGES.items():
        hit, value = any_of(low, words), F.lit(f"language:{name}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    if project:
        out = out.when(any_of(low, PROJECT), F.lit(f"project:{project}"))
    return out.otherwise("universal")


# Words that decide a category, in this order, then kinds of corrections that are rules.
CATEGORIES = (("correction", ("never", "don't", "avoid", "stop")), ("rule", ("always", "must", "limit", "max")), ("preference", ("prefer", "like", "use", "keep")))
RULE_KINDS = ("behavior", "rule")
# End of fixed values.


def category(text: Column, kind: Column) -> Column:
    """The category of the first words that a text has, else that of its kind."""
    low = F.lower(text)
    return F.coalesce(*[F.when(any_of(low, words), name) for name, words in CATEGORIES], F.when(kind.isin(*RULE_KINDS), "rule"), F.lit("preference"))


def imperative(text: Column, most: int = 20) -> Column:
    """A correction as a rule: rewritten, capitalised, at most ``most`` words."""
    plain = F.trim(text)
    new = plain
    for pattern, to in REWRITES:
        new = F.regexp_replace(new, pattern, to)
    up = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))
    words = F.split(new, "\\s+")
    new = F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("..."))).otherwise(new)
    return F.when(F.split(F.lower(plain), "\\s+")[0].isin(*STARTERS), up(plain)).otherwise(up(new))


def rationale(frequency: Column, confidence: Column) -> Column:
    return (
        F.when(frequency >= 3, F.format_string("Corrected %d times", frequency))
        .when(frequency == 2, F.lit("Corrected twice"))
        .when(confidence >= 0.9, F.lit("Clear instruction"))
        .otherwise("Inferred from a session")
    )


def context_share(mode_: str, files: Column, tools: Column) -> Column:
    """What the files changed and tools used so far tell of a mode: 0.3 or nothing."""
    used = lambda *names: reduce(lambda a, b: a | b, [F.array_contains(tools, n) for n in names])
    speaks = {
        "prototype": lambda: used("Write"),
        "refactor": lambda: F.size(F.filter(tools, lambda t: t == "Edit")) > 3,
        "production": lambda: F.exists(files, lambda f: f.contains("test")),
        "audit": lambda: used("Read") & ~used("Edit", "Write"),
        "exploration": lambda: used("Grep", "Glob"),
    }
    return F.when(speaks[mode_](), 0.3).otherwise(0.0) if mode_ in speaks else F.lit(0.0)


def mode_scores(prompt: Column, files: Column | None = None, tools: Column | None = None) -> Column:
    """Mode to score: 0.3 per indicator, up to 0.3 for scope, 0.2 for urgency and, where ``files`` changed and ``tools`` used are told, 0.2 for these; at most 1."""
    low = F.lower(prompt)
    share = lambda words, each, more=None: F.least(F.lit(1.0), sum((low.contains(w).cast("double") * each for w in words), F.lit(0.0) if more is None else more))
    told = files is not None and tools is not None

    def scoped(scopes):
        few = [w for w in ("single file", "specific function") if w in scopes]
        many = [w for w in ("multiple files", "system") if w in scopes]
        more = F.when((F.size(files) == 1) & F.lit(bool(few)) | (F.size(files) > 5) & F.lit(bool(many)), 0.3).otherwise(0.0) if told else None
        return share(scopes, 0.5, more)

    parts = []
    for mode, (own, scopes, times) in MODES.items():
        own_score = sum((low.contains(w).cast("double") * 0.3 for w in own), F.lit(0.0))
        parts += [F.lit(mode), F.least(F.lit(1.0), own_score + 0.3 * scoped(scopes) + 0.2 * share(times, 0.5) + (0.2 * context_share(mode, files, tools) if told else F.lit(0.0)))]
    return F.create_map(*parts)


def mode(prompt: Column, files: Column | None = None, tools: Column | None = None) -> Column:
    """The mode with the highest score; of equals the one that is defined first."""
    scores = mode_scores(prompt, files, tools)
    order = F.array(*[F.struct((-scores[m]).alias("s"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(MODES)])
    return F.array_min(order)["m"]


def is_noise(subject: Column) -> Column:
    """Commit subjects that tell nothing."""
    low = F.trim(F.lower(subject))
    return starts_with_any(low, ("merge", "wip", "temp", "bump version")) | low.rlike("^v?\\d+\\.\\d+")


def commit_pattern(subject: Column) -> Column:
    """(type, content, confidence) of a commit that states a decision or a correction, else null."""
    low = F.lower(subject)
    decision = F.regexp_extract(low, "(?:decided to|chose|switch(?:ed)? to|migrat\\w+ to|use \\w+ instead of|replace \\w+ with) .+", 0)
    correction = F.regexp_extract(low, "(?:fix(?:ed)?(?:\\([^)]*\\))?:?|prevent|avoid|never|don't) (.+)", 1)
    row = lambda kind, content, c: F.struct(F.lit(kind).alias("type"), F.trim(content).alias("content"), F.lit(c).alias("confidence"))
    return F.when(F.length(decision) > 20, row("decision", decision, 0.7)).when(F.length(correction) > 10, row("correction", correction, 0.6))
