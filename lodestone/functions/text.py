"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of ``[A-Za-z0-9_]``; matched before lower-casing. Null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


#: Words that searches leave out.
STOP = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "it", "this", "that")


def keywords(text: Column, most: int | None = None) -> Column:
    """Lower-cased tokens longer than two characters that are no stop words, in order, once each."""
    out = F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))
    return out if most is None else F.slice(out, 1, most)


def content_words(text: Column) -> Column:
    """Words of a memory: split at white space, stop words left out, then ``.,!?;:`` stripped; longer than two characters."""
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda w: ~w.isin(*STOP))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^[.,!?;:]+|[.,!?;:]+$", "")), lambda w: F.length(w) > 2))


def stem(word: Column) -> Column:
    """Drops one of ing, ed, s from words that are long enough."""
    n = F.length(word)
    return F.when(word.endswith("ing") & (n > 5), F.substring(word, 1, n - 3)).when(word.endswith("ed") & (n > 4), F.substring(word, 1, n - 2)).when(word.endswith("s") & (n > 3), F.substring(word, 1, n - 1)).otherwise(word)


def snippet(text: Column, words: list[str], before: int = 30, after: int = 50, whole: int = 100) -> Column:
    """The surroundings of the first of ``words`` that the text has, in their order, else its first ``whole`` characters."""
    out = F.substring(text, 1, whole)
    for w in reversed(words):
        at = F.locate(w.lower(), F.lower(text))
        start = F.greatest(F.lit(1), at - before)
        out = F.when(at > 0, F.substring(text, start, at + after - start)).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def escape_query(q: Column) -> Column:
    """A full-text query in quotes if it has special characters and no AND, OR or NOT; quotes in it are doubled."""
    special = q.rlike("[^A-Za-z0-9_\\s]")
    boolean = q.rlike("\\b(?:AND|OR|NOT)\\b")
    return F.when(special & ~boolean, F.concat(F.lit('"'), F.replace(q, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(q)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters; 0 for null and empty."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def word_token_estimate(text: Column) -> Column:
    """1.3 per word, rounded down."""
    return F.floor(F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")) * 1.3).cast("long")


def branches(code: Column) -> Column:
    """Keywords and operators that branch."""
    return F.regexp_count(code, F.lit("\\b(?:if|elif|for|while|except|case|and|or|catch)\\b|&&|\\|\\|"))


def code_lines(code: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(F.split(code, "\n"), lambda x: ~F.trim(x).rlike("^(?:#|//|$)")))


def nesting(code: Column, step: int = 4) -> Column:
    """The deepest indentation over the first line's, in steps; blank lines do not count."""
    lines = F.filter(F.split(code, "\n"), lambda x: F.trim(x) != "")
    indent = F.transform(lines, lambda x: F.length(x) - F.length(F.ltrim(x)))
    return F.coalesce(F.floor((F.array_max(indent) - indent[0]) / step), F.lit(0)).cast("int")


def skeleton_lines(code: Column) -> Column:
    """Signatures and comment lines of a source text."""
    keep = F.filter(F.split(code, "\n"), lambda x: F.trim(x).rlike("^(?:def |class |async def |function |interface |export |func |type |#|//)"))
    return F.array_join(keep, "\n")


def line_range(text: Column, start: Column, end: Column, padding: int = 0) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive) with ``padding`` more on both sides, within the text."""
    lines = F.split(text, "\n")
    first, last = F.greatest(F.lit(1), start - padding), F.least(F.size(lines), end + padding)
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")


def fixed(text: Column) -> Column:
    """A text without blanks and tabs at the ends of lines, with two blank lines in a row at most and one line end behind."""
    plain = F.regexp_replace(text, "[ \t]+(\n|\\z)", "$1")
    return F.concat(F.regexp_replace(F.regexp_replace(plain, "\n{4,}", "\n\n\n"), "\n+\\z", ""), F.lit("\n"))


def base_type(annotation: Column) -> Column:
    """``Optional[X]`` gives X's base, ``List[X]`` gives List, a dotted name its last part; three levels deep."""
    out = F.trim(annotation)
    for _ in range(3):
        out = F.regexp_replace(out, "^(?:typing\\.)?Optional\\[(.*)\\]$", "$1")
        out = F.regexp_replace(out, "^(.*?)\\s*\\|\\s*None$", "$1")
    out = F.regexp_replace(out, "\\[.*$", "")
    return F.when(annotation.rlike("^\\w+$"), annotation).otherwise(F.element_at(F.split(out, "\\."), -1))  # most are plain names
