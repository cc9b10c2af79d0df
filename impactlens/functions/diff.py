"""Unified diffs: changed files with the methods and types on their changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that are no method names.
KEYWORDS = (
    "if else while for foreach do switch case return break continue try catch finally throw using namespace class interface struct enum "
    "var new this base null true false static public private protected internal override virtual abstract sealed readonly const async await"
).split()
#: A name with parentheses after it counts if it follows a word (as after its type), or if the line or a statement ends,
#: or a body begins, behind them.
DECLARED = r"[\w>\]]\s+(\w+)(?:<[^>]*>)?\s*\([^)]*\)"
ENDED = r"(\w+)\s*\([^)]*\)(?=\s*(?:$|[{;]))"
TYPE = r"\b(?:class|interface|struct|enum)\s+(\w+)"


def changes(diffs: DataFrame) -> DataFrame:
    """diffs (diff_id, text): diff_id, file_path, change_type, changed_methods, changed_types for each .cs file of which
    a changed line names a method or a type. Lines are numbered and each is given its file by a window over its diff."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    header = F.regexp_extract("line", r"^diff --git a/(.*) b/.*$", 1)
    order = Window.partitionBy("diff_id").orderBy("n")
    lines = lines.withColumn("file", F.last(F.when(header != "", F.regexp_extract("line", r" b/(.*)$", 1)), ignorenulls=True).over(order))
    added = F.col("line").startswith("new file mode") | (F.col("line") == "--- /dev/null")
    deleted = F.col("line").startswith("deleted file mode") | (F.col("line") == "+++ /dev/null")
    changed = F.col("line").rlike("^[+-]") & ~F.col("line").rlike(r"^(\+\+\+|---)")
    body = F.when(changed, F.expr("substring(line, 2)"))
    found = lines.where("file is not null").groupBy("diff_id", F.col("file").alias("file_path")).agg(
        F.when(F.max(added), "Added").when(F.max(deleted), "Deleted").otherwise("Modified").alias("change_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in (DECLARED, ENDED))))))).alias("m"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(body, F.lit(TYPE), F.lit(1)))))).alias("changed_types"),
    )
    found = found.withColumn("changed_methods", F.filter("m", valid)).drop("m")
    named = (F.size("changed_methods") > 0) | (F.size("changed_types") > 0)
    return found.where(F.lower("file_path").endswith(".cs") & named).select("diff_id", "file_path", "change_type", "changed_methods", "changed_types")


def valid(name):
    """Whether a name can be a method's."""
    return name.rlike("^[A-Za-z][A-Za-z0-9_]+$") & ~F.lower(name).isin(KEYWORDS) & ~name.rlike("(?i)^variable_|regex")
