"""Tokens, trigrams, chunks and glob patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; none for texts below three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1))  # overlapping, in one linear scan


def code_tokens(text: Column) -> Column:
    """Lower-cased tokens split at non-alphanumerics and at camel-case and acronym boundaries."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " "), r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))


def fixed_chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Chunks of ``size`` characters, each ``size - overlap`` after the last, until one reaches the end."""
    step, n = size - overlap, F.char_length(text)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / float(step)).cast("int"))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, i * step + 1, F.lit(size))))


def looks_regex(query: Column) -> Column:
    return query.rlike(r"[\^$.*+?\[\]()|]")


def keyword_share(words_: Column, text: Column) -> Column:
    """Share of the query words of three bytes or more that the text holds, in any case."""
    usable = F.filter(words_, lambda w: F.octet_length(w) >= 3)
    return F.when(F.size(usable) == 0, 0.0).otherwise(F.size(F.filter(usable, lambda w: F.contains(F.lower(text), F.lower(w)))).cast("double") / F.size(usable))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: * and ? cross directories as in the usual glob sets, ** any depth, [..] and {a,b}."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
            continue
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def mandatory_literals(pattern: str) -> list[str]:
    """Literal runs that every match of the pattern must hold; alternatives contribute nothing, so a filter on them is sound."""
    import re._constants as C
    import re._parser as parser

    runs: list[str] = []

    def walk(parsed) -> None:
        held = ""
        for op, value in parsed:
            if op is C.LITERAL:
                held += chr(value)
                continue
            runs.append(held)
            held = ""
            if op is C.SUBPATTERN:
                walk(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
                walk(value[2])
        runs.append(held)

    walk(parser.parse(pattern))
    return [r for r in runs if len(r) >= 3]


def pattern_trigrams(pattern: str) -> list[str]:
    """Trigrams of the mandatory literals, lower-cased; empty: every document is a candidate."""
    return sorted({r.lower()[i : i + 3] for r in mandatory_literals(pattern) for i in range(len(r) - 2)})
