"""Scalar functions on method and test names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_parameters(c: Column) -> Column:
    """Up to the first parenthesis, unless the name begins with it."""
    return F.when(F.instr(c, "(") > 1, F.substring_index(c, "(", 1)).otherwise(c)


def name_only(c: Column) -> Column:
    return F.substring_index(without_parameters(c), ".", -1)


def normalized(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)^global::", "")


def matches(c: Column, pattern: Column) -> Column:
    p = F.lower(pattern)
    return (F.lower(c) == p) | (F.lower(normalized(c)) == p) | (F.lower(without_parameters(c)) == p) | (F.lower(name_only(c)) == p)


def parameters(c: Column) -> Column:
    """The parameter types between the outer parentheses; null without any."""
    inner = F.regexp_extract(c, r"\((.*)\)", 1)
    return F.when(F.instr(c, "(") == 0, F.lit(None).cast("array<string>")).when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), F.trim))


def type_qualifier(c: Column) -> Column:
    """The segment before the method's name; empty if there is none."""
    parts = F.split(without_parameters(c), r"\.")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise("")


def pattern_matches(method: Column, pattern: Column) -> Column:
    """Equal names; the method's type ends with the pattern's; and, if the pattern names parameters, as many of them,
    each ending with its hint."""
    named = name_only(method) == name_only(pattern)
    typed = (type_qualifier(pattern) == "") | F.endswith(type_qualifier(method), type_qualifier(pattern))
    own, hints = F.coalesce(parameters(method), F.array().cast("array<string>")), parameters(pattern)
    hinted = hints.isNull() | ((F.size(own) == F.size(hints)) & F.forall(F.zip_with(own, hints, lambda a, b: F.endswith(a, b)), lambda x: x))
    return named & typed & hinted


def camel_parts(c: Column) -> Column:
    """Runs that begin at an upper-case letter, longer than two characters."""
    return F.filter(F.regexp_extract_all(c, F.lit("[A-Z]?[^A-Z]+|[A-Z]"), F.lit(0)), lambda t: F.length(t) > 2)


def tokens(c: Column, camel: bool = True) -> Column:
    """Distinct lower-case parts, longer than two characters, split at _ - . and space (and before capitals)."""
    parts = F.split(c, r"[_\-. ]")
    found = F.concat(parts, F.flatten(F.transform(parts, camel_parts))) if camel else parts
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 2), F.lower))


def namespace(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), ".")).otherwise("")


def container(c: Column) -> Column:
    """The namespace of a method: all but its last two parts; of two parts the first; null of one."""
    parts = F.split(c, r"\.")
    n = F.size(parts)
    return F.when(n > 2, F.array_join(F.slice(parts, F.lit(1), n - 2), ".")).when(n == 2, parts[0])


def approximate_id(namespace_: Column, class_: Column, name: Column, count: Column) -> Column:
    """namespace.class.name.(n params), without the parts that are null."""
    return F.concat_ws(".", namespace_, class_, name, F.concat(F.lit("("), count.cast("string"), F.lit(" params)")))


def type_of_file(path: Column, root: str = "") -> Column:
    """The type that a file would hold by its place: the folders below src as a namespace, and its name."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    below = F.translate(F.regexp_extract(path, r"(?:^|/)src/(?:(.*)/)?[^/]*$", 1), "/", ".")
    return F.concat_ws(".", F.nullif(F.lit(root), F.lit("")), F.nullif(below, F.lit("")), stem)


def pattern_of_class(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("Test")), F.replace(c, F.lit("Test"), F.lit(""))).otherwise("Unknown")


def conventional_dependency(namespace_: Column, class_: Column) -> Column:
    """FooTests in X.Tests is about X.Foo."""
    return F.concat_ws(".", F.regexp_replace(namespace_, r"\.Tests?$", ""), F.regexp_replace(class_, "Tests?$", ""))


def seconds(c: Column) -> Column:
    """30s, 5m, 1h or plain seconds; null if it is none of these."""
    n = F.try_to_number(F.regexp_extract(c, r"^\s*(\d+)\s*[smhSMH]?\s*$", 1), F.lit("999999999999")).cast("double")
    unit = F.lower(F.regexp_extract(c, r"([smhSMH])\s*$", 1))
    return n * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)


def method_identifier(type_: Column, name: Column, types: Column) -> Column:
    return F.concat(type_, F.lit("."), name, F.lit("("), F.array_join(types, ","), F.lit(")"))


def grams(c: Column, n: int = 3) -> Column:
    """n-grams of an array, joined by ->; an array of fewer has none."""
    return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), "->"))).otherwise(F.array().cast("array<string>"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("long")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def glob_matches(c: Column, pattern: str) -> Column:
    """With * the whole must match, ignoring case (? is any character, and so is a dot); else it must be contained."""
    if "*" in pattern:
        return c.rlike("(?i)^" + pattern.replace("*", ".*").replace("?", ".") + "$")
    return F.contains(F.lower(c), F.lit(pattern.lower()))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False))
    return out
