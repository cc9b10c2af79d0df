"""Rules that sort tests and methods into categories, as Columns. Rules are data; callers can pass their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from impactlens.functions.names import contains_any

# Category, priority, words, and where they are looked for.
RULES = [
    ("EndToEnd", 90, ["e2e", "endtoend"], ["method", "class", "namespace"]),
    ("UI", 85, ["ui", "selenium", "webdriver", "browser"], ["method", "class"]),
    ("Database", 80, ["database", "db", "sql", "entity", "ef6", "efcore", "repository"], ["method", "class"]),
    ("API", 75, ["api", "http", "rest", "controller", "endpoint"], ["method", "class"]),
    ("API", 75, ["api", "controllers"], ["namespace"]),
    ("Performance", 70, ["performance", "load", "stress", "benchmark"], ["method", "class"]),
    ("Security", 65, ["security", "auth", "authorization", "authentication", "permission"], ["method", "class"]),
    ("Integration", 60, ["integration"], ["method", "class", "namespace", "assembly"]),
    ("Unit", 55, ["nunittestdiscovery", "testdiscovery"], ["class"]),
    ("Unit", 50, ["service", "factory", "analyzer", "discovery", "utility", "helper"], ["class"]),
]
# Words of method categories.
FRAMEWORK = "system. microsoft. nunit. xunit. moq. fluentassertions.".split()
THIRD_PARTY = "newtonsoft. automapper. serilog. npgsql. entityframework. dapper. polly. mediatr. hangfire. quartz.".split()
DATA_ACCESS = "repository dbcontext dataaccess dal entity mapper query command".split()
INFRASTRUCTURE = "factory provider manager helper utility configuration logging logger caching cache".split()
# Words in the names of tests.
TEST_WORDS = ["test", "spec", "should", "when", "given", "scenario", "example", "verify", "check", "ensure", "benchmark", "calculate"]


def named_like_test(name: Column) -> Column:
    return contains_any(name, TEST_WORDS)


def category(method: Column, class_: Column, namespace: Column, assembly: Column, rules: list = RULES) -> Column:
    """The matching rule of highest priority; Unit if none matches."""
    where = {"method": method, "class": class_, "namespace": namespace, "assembly": assembly}
    out = F.lit("Unit")
    for name, _, words, places in sorted(rules, key=lambda r: r[1]):
        hit = F.lit(False)
        for p in places:
            hit = hit | contains_any(where[p], words)
        out = F.when(hit, name).otherwise(out)
    return out


def in_test_project(path: Column) -> Column:
    return contains_any(path, ["test", "spec"])


def test_type(is_test: Column, path: Column, name: Column, type_: Column) -> Column:
    """What kind of test a method is; the most specific words first."""
    e2e = contains_any(path, ["e2e", "endtoend"]) | contains_any(name, ["e2e", "endtoend", "scenario", "journey"])
    integration = contains_any(path, ["integration"]) | contains_any(name, ["integration"]) | contains_any(type_, ["integration"])
    performance = contains_any(path, ["performance", "benchmark"]) | contains_any(name, ["performance", "benchmark"]) | contains_any(type_, ["performance", "benchmark"])
    security = contains_any(path, ["security"]) | contains_any(name, ["security", "auth", "permission"]) | contains_any(type_, ["security"])
    return F.when(~is_test, "Unknown").when(e2e, "End2End").when(integration, "Integration").when(performance, "Performance").when(security, "Security").otherwise("Unit")


def test_confidence(path: Column, name: Column, type_: Column) -> Column:
    """How likely a method is a test, from its place and names."""
    project, file = in_test_project(path), contains_any(F.regexp_extract(path, r"([^/\\]*)$", 1), ["test", "spec"])
    named, classed = named_like_test(name), F.lower(type_).rlike("(test|tests|spec|specs)$")
    attributes = (project | file) & (named | classed)
    points = [(attributes, 0.8), (project, 0.3), (file, 0.2), (named, 0.4), (classed, 0.2)]
    return F.least(F.lit(1.0), sum((F.when(c, v).otherwise(0.0) for c, v in points), F.lit(0.0)))


def method_category(is_test: Column, type_: Column, name: Column) -> Column:
    t = F.lower(type_)
    starts = lambda words: t.rlike("^(" + "|".join(w.replace(".", r"\.") for w in words) + ")")
    either = lambda words: contains_any(type_, words) | contains_any(name, words)
    return F.when(is_test, "TestUtility").when(starts(FRAMEWORK), "Framework").when(starts(THIRD_PARTY), "ThirdParty").when(either(DATA_ACCESS), "DataAccess").when(either(INFRASTRUCTURE), "Infrastructure").otherwise("BusinessLogic")


def is_test(flag: Column, path: Column, name: Column) -> Column:
    """A method that is marked as a test, or is named like one in a test project."""
    return F.coalesce(flag, F.lit(False)) | (in_test_project(path) & named_like_test(name))


def change_type(path: Column) -> Column:
    """A configuration if the file's name has config in it or ends in .json or .xml."""
    return F.when(F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)).rlike(r"config|\.(json|xml)$"), "Configuration").otherwise("Modified")


def access_type(method: Column) -> Column:
    return (
        F.when(contains_any(method, ["create", "add", "insert"]), "Create").when(contains_any(method, ["update", "modify"]), "Update")
        .when(contains_any(method, ["delete", "remove"]), "Delete").when(contains_any(method, ["read", "get", "find"]), "Read").otherwise("ReadWrite")
    )


def looks_like_test(attributes: Column, name: Column, class_: Column) -> Column:
    """An attribute, or else the method's or the class's name, that ends like a test's."""
    marked = F.exists(attributes, lambda a: a.rlike("(?i)(test|testmethod|fact|theory)$"))
    return F.coalesce(marked, F.lit(False)) | F.coalesce(name.rlike("(?i)tests?$"), F.lit(False)) | F.coalesce(class_.rlike("(?i)tests?$"), F.lit(False))


def call_type(extension: Column, static: Column, virtual: Column, interface: Column) -> Column:
    return F.when(extension, "Extension").when(static, "Static").when(virtual, "Virtual").when(interface, "Interface").otherwise("Direct")
