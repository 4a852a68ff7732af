"""Regular expressions as Spark SQL text over a named column.

Operators are stated as SQL expressions and parsed once each: building the same
trees node by node from Python takes thousands of calls into the JVM per query.

``(?U)`` makes ``\\b``, ``\\d``, ``\\s`` and ``\\w`` Unicode-aware on the JVM, and
with ``i`` gives Unicode case folding; without it non-ASCII text would match
differently from the published patterns.
"""

from __future__ import annotations

from collections.abc import Iterable

NAME_TAIL = r"(?:\s+[A-Z][a-z]+)*"


def quoted(text: str) -> str:
    """A SQL string literal that means the same under every setting of the parser.

    Sessions may read backslashes as they stand (``escapedStringLiterals``), so texts
    with backslashes or quotes are given by their bytes.
    """
    if "\\" in text or "'" in text:
        return f"cast(X'{text.encode().hex()}' as string)"
    return f"'{text}'"


def jvm_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for the JVM, where a repeated group needs stack for every turn.

    Name tails end their patterns, so giving nothing back changes no match; it keeps
    long runs of words from overflowing the stack.
    """
    return ("(?iU)" if ignore_case else "(?U)") + pattern.replace(NAME_TAIL, NAME_TAIL + "+")


def empty_array(ddl: str = "string") -> str:
    return f"cast(array() as array<{ddl}>)"


def find_all(text: str, pattern: str, group: int = 0, ignore_case: bool = False) -> str:
    """All matches, left to right; null text gives an empty array."""
    found = f"regexp_extract_all({text}, {quoted(jvm_pattern(pattern, ignore_case))}, {group})"
    return f"coalesce({found}, {empty_array()})"


def matches(text: str, pattern: str, ignore_case: bool = False) -> str:
    """True where the pattern occurs; null text gives false."""
    return f"coalesce(rlike({text}, {quoted(jvm_pattern(pattern, ignore_case))}), false)"


def gaps(text: str, pattern: str) -> str:
    """The text around the matches: always one element more than there are matches."""
    return f"split({text}, {quoted(jvm_pattern(pattern))}, -1)"


def holds_any(text: str, literals: Iterable[str]) -> str:
    """Plain byte search; far cheaper than a pattern."""
    return "(" + " or ".join(f"contains({text}, {quoted(x)})" for x in literals) + ")"


def only_if(condition: str, found: str, ddl: str = "string") -> str:
    """``found`` where the condition holds, else an empty array."""
    return f"case when {condition} then {found} else {empty_array(ddl)} end"
