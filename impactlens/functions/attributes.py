"""What attributes say about methods and fixtures, as Columns over names of attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from impactlens.functions.names import contains_any

# Names of attributes by what they mark.
MARKS = {
    "test": "TestAttribute FactAttribute TestMethodAttribute",
    "case": "TestCaseAttribute TheoryAttribute DataTestMethodAttribute",
    "setup": "SetUpAttribute TestInitializeAttribute",
    "teardown": "TearDownAttribute TestCleanupAttribute",
    "setup_once": "OneTimeSetUpAttribute ClassInitializeAttribute",
    "teardown_once": "OneTimeTearDownAttribute ClassCleanupAttribute",
    "fixture": "TestFixtureAttribute SetUpFixtureAttribute TestClassAttribute",
}
# Words of attributes that have to do with tests.
RELATED = "test setup teardown ignore category fact theory initialize cleanup trait skip collection owner priority explicit"
EXCLUSIVE = ["Exclusive", "Sequential", "NonParallel"]
TAG_WORDS = ["category", "slow", "integration"]


def marks(attribute: Column, kind: str) -> Column:
    return F.lower(attribute).isin(MARKS[kind].lower().split())


def any_marks(attributes: Column, *kinds: str) -> Column:
    return F.exists(attributes, lambda a: F.coalesce(F.lower(a).isin(" ".join(MARKS[k] for k in kinds).lower().split()), F.lit(False)))


def is_executable(attributes: Column) -> Column:
    return any_marks(attributes, "test", "case")


def is_test_method(attributes: Column) -> Column:
    """Tests, cases, and what sets them up or tears them down."""
    return any_marks(attributes, "test", "case", "setup", "teardown", "setup_once", "teardown_once")


def is_fixture(attributes: Column, method_attributes: Column) -> Column:
    """A class that is marked, or one of whose methods (an array of arrays) is a test method."""
    return any_marks(attributes, "fixture") | F.exists(method_attributes, is_test_method)


def is_related(attribute: Column) -> Column:
    return contains_any(attribute, RELATED.split())


def tags(attributes: Column) -> Column:
    """The tag words that any attribute's name contains, in their order."""
    found = lambda word: F.exists(attributes, lambda a: F.contains(F.lower(a), F.lit(word)))
    return F.filter(F.array(*(F.when(found(w), w) for w in TAG_WORDS)), lambda x: x.isNotNull())


def values_of(pairs: Column, kind: str) -> Column:
    """Values of the attributes (an array of name, value) named CategoryAttribute or marking cases."""
    named = (lambda a: F.lower(a["name"]) == "categoryattribute") if kind == "category" else (lambda a: marks(a["name"], "case"))
    return F.transform(F.filter(pairs, lambda a: named(a) & a["value"].isNotNull() & (a["value"] != "")), lambda a: a["value"])


def wants_to_be_alone(attributes: Column) -> Column:
    return F.exists(attributes, lambda a: F.greatest(F.lit(False), *(F.contains(a, F.lit(w)) for w in EXCLUSIVE)))
