"""What source text says about itself: declarations, calls, uses of types, attributes and tests.

Files (path, content) are cut into lines; the namespace, the type and the method are carried on within each row. That is
pattern matching, not a compiler: types of variables aren't known, so a call on one counts for every method of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.functions import attributes, classify, diff, names
from impactlens.operators.graph import with_overrides
from impactlens.sources.cut import cut

#: Words that may stand where a declaration has its type, but begin a statement.
STATEMENTS = "return await throw new else yield using goto case lock in is as".split()
MODIFIERS = "public private protected internal static virtual override abstract sealed async extern partial unsafe new".split()
NAMESPACE = r"^\s*namespace\s+([\w.]+)"
TYPE = r"^\s*(?:\w+\s+)*?(class|interface|struct|record)\s+(\w+)(?:<[^>]*>)?\s*(?::\s*([^{]*))?"
DECLARATION = r"^\s*((?:(?:" + "|".join(MODIFIERS) + r")\s+)*)(?:([A-Za-z_][\w<>\[\],?.]*)\s+)?(\w+)\s*(?:<[^>]*>)?\s*\(([^()]*)\)\s*(?:\{.*|=>.*|where\b.*|;)?\s*$"
ATTRIBUTE = r"\[\s*(\w+)\s*(?:\(\s*([^()]*)\))?\s*\]"


def marks_of_lines(files: DataFrame) -> DataFrame:
    """path, texts (the lines of a file, without comments) and marks: for the first line, and each that declares something,
    its number n, the namespace, type t and method m that hold from there on, and what the line itself declares (own_t,
    own_m). Each file is read within its row, so nothing is shuffled or sorted."""
    lines = files.select("path", F.transform(F.split(F.coalesce("content", F.lit("")), r"\r?\n"), lambda x: F.when(x.contains("//"), F.regexp_replace(x, r"//.*$", "")).otherwise(x)).alias("texts"))

    def found(text: Column, n: Column) -> Column:
        part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
        bare = F.when(text.contains("["), F.regexp_replace(text, ATTRIBUTE, "")).otherwise(text)
        of = lambda k: F.regexp_extract(bare, DECLARATION, k)
        result = of(2)
        declares = (of(3) != "") & ~result.isin(STATEMENTS) & ~F.lower(of(3)).isin(diff.KEYWORDS) & ((result != "") | (F.trim(of(1)) != ""))
        signature = F.struct(of(3).alias("name"), F.split(F.trim(of(1)), r"\s+").alias("modifiers"), of(4).alias("parameters"), n.alias("at"))
        type_ = F.struct(part(TYPE, 2).alias("name"), part(TYPE, 1).alias("kind"), F.coalesce(part(TYPE, 3), F.lit("")).alias("bases"), n.alias("at"))
        named = text.rlike(r"\b(class|interface|struct|record)\s") & part(TYPE, 2).isNotNull()  # the plain tests before the dear ones
        return F.struct(n.alias("n"), F.when(text.contains("namespace"), part(NAMESPACE, 1)).alias("ns"), F.when(named, type_).alias("t"), F.when(text.contains("(") & bare.rlike(DECLARATION) & declares, signature).alias("m"))

    some = lines.select("path", "texts", F.filter(F.transform("texts", found), lambda x: (x["n"] == 0) | x["ns"].isNotNull() | x["t"].isNotNull() | x["m"].isNotNull()).alias("some"))
    kept = "struct<n:int,ns:string,t:struct<name:string,kind:string,bases:string,at:int>,m:struct<name:string,modifiers:array<string>,parameters:string,at:int>"
    nothing = F.lit(None).cast(f"struct<last:{kept}>,all:array<{kept},own_t:boolean,own_m:boolean>>>")

    def carry(held: Column, x: Column) -> Column:
        now = F.struct(x["n"].alias("n"), *(F.coalesce(x[k], held["last"][k]).alias(k) for k in ("ns", "t", "m")))
        one = F.struct(*(now[k].alias(k) for k in ("n", "ns", "t", "m")), x["t"].isNotNull().alias("own_t"), x["m"].isNotNull().alias("own_m"))
        return F.struct(now.alias("last"), F.concat(F.coalesce(held["all"], F.array().cast(f"array<{kept},own_t:boolean,own_m:boolean>>")), F.array(one)).alias("all"))

    return some.select("path", "texts", F.aggregate("some", nothing, carry, lambda held: held["all"]).alias("marks"))


def _facts(mark: Column) -> list[Column]:
    """namespace, type, kind, bases, method, modifiers and parameters that hold from a mark on."""
    inside = mark["m"].isNotNull() & (mark["t"]["at"] <= mark["m"]["at"])
    return [
        F.coalesce(mark["ns"], F.lit("")).alias("namespace"), mark["t"]["name"].alias("type"), mark["t"]["kind"].alias("kind"), mark["t"]["bases"].alias("bases"),
        F.when(inside, mark["m"]["name"]).alias("method"), F.when(inside, mark["m"]["modifiers"]).alias("modifiers"), F.when(inside, mark["m"]["parameters"]).alias("parameters"),
        F.coalesce(inside & mark["own_m"], F.lit(False)).alias("declares_method"), F.coalesce(mark["own_t"], F.lit(False)).alias("declares_type"),
    ]


def code_lines(files: DataFrame) -> DataFrame:
    """path, line, text, namespace, type, kind, bases, method and what its declaration says, for each line. A declaration's
    own line belongs to what it declares."""
    until = lambda k: F.coalesce(F.get("marks", k + 1)["n"], F.size("texts"))
    pieces = F.transform("marks", lambda x, k: F.struct(x.alias("mark"), F.slice("texts", x["n"] + 1, until(k) - x["n"]).alias("texts")))
    rows = marks_of_lines(files).select("path", F.explode_outer(pieces).alias("p")).select("path", "p.mark", F.posexplode_outer("p.texts").alias("k", "text"))
    first = F.col("k") == 0
    *facts, method, type_ = _facts(F.col("mark"))
    return rows.select("path", (F.col("mark.n") + F.col("k") + 1).alias("line"), "text", *facts, (first & method).alias("declares_method"), (first & type_).alias("declares_type"))


def declarations(files: DataFrame) -> DataFrame:
    """The lines of code_lines that declare a type or method."""
    rows = marks_of_lines(files).select("path", F.explode_outer("marks").alias("mark"))
    return rows.select("path", (F.col("mark.n") + 1).alias("line"), *_facts(F.col("mark"))).where("declares_method or declares_type")


def qualified(*parts: Column) -> Column:
    return F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in parts))


def declared(files: DataFrame) -> DataFrame:
    """method_id, path, line, namespace, type, kind, name, parameters (their number), static, virtual, extension."""
    return _declared(declarations(files))


def _declared(found: DataFrame) -> DataFrame:
    own = found.where("declares_method and type is not null")
    many = F.when(F.trim("parameters") == "", 0).otherwise(F.size(F.split("parameters", ",")))
    has = lambda *words: F.arrays_overlap("modifiers", F.array(*(F.lit(w) for w in words)))
    return own.select(
        qualified(F.col("namespace"), F.col("type"), F.col("method")).alias("method_id"), "path", "line", "namespace", "type", "kind", F.col("method").alias("name"), many.alias("parameters"),
        has("static").alias("static"), has("virtual", "override", "abstract").alias("virtual"), F.trim("parameters").startswith("this ").alias("extension"),
    )


def types(files: DataFrame) -> DataFrame:
    """path, namespace, type, kind, bases (an array, without type arguments)."""
    return _types(declarations(files))


def _types(found: DataFrame) -> DataFrame:
    bases = F.transform(F.split(F.regexp_replace(F.regexp_replace("bases", r"<[^<>]*>", ""), r"\bwhere\b.*", ""), ","), lambda b: F.substring_index(F.trim(b), ".", -1))
    return found.where("declares_type").select("path", "namespace", "type", "kind", F.filter(bases, lambda b: b != "").alias("bases"))


def calls(files: DataFrame) -> DataFrame:
    """path, line, caller, own_type, expression, qualifier, callee, kind of each call: constructors, methods, properties
    that are read or set, and methods handed over as delegates."""
    body = code_lines(files).where("method is not null and not declares_method and type is not null").withColumn("text", F.regexp_replace("text", r"^\s*(?:\[[^\]]*\]\s*)+", ""))
    nothing = F.array().cast("array<struct<expression:string,kind:string>>")

    def found(holds: str, pattern: str, kind: str) -> Column:
        """What a pattern finds in lines that hold a character which it can't do without."""
        some = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda e: F.struct(F.regexp_replace(e, r"\s", " ").alias("expression"), F.lit(kind).alias("kind")))
        return F.when(F.contains(F.col("text"), F.lit(holds)), some).otherwise(nothing)

    every = F.concat(
        found("new", r"\bnew\s+([A-Za-z_][\w.]*)\s*(?:<[^<>()]*>)?\s*\(", "Constructor"),
        found("(", r"(?<!\bnew\s)(?<![\w.])((?:[A-Za-z_]\w*\s*\.\s*)*[A-Za-z_]\w*)\s*(?:<[\w\s,.]*>)?\s*\(", "Method"),
        found(")", r"\)\s*\.\s*([A-Za-z_]\w*)\s*(?:<[\w\s,.]*>)?\s*\(", "Method"),
        found("=", r"(?<![\w.])([A-Za-z_]\w*\.[A-Z]\w*)(?!\w)\s*=(?!=)", "PropertySet"),
        found(".", r"(?<![\w.])([A-Za-z_]\w*\.[A-Z]\w*)(?![\w.])(?!\s*[(<])(?!\s*=(?!=))", "PropertyGet"),
        found("=", r"[+-]=\s*([A-Za-z_][\w.]*)\s*;", "Delegate"),
    )
    rows = body.select("path", "line", "namespace", "type", qualified(F.col("namespace"), F.col("type"), F.col("method")).alias("caller"), F.explode_outer(every).alias("e")).where("e is not null")
    rows = rows.select("path", "line", "caller", F.col("type").alias("own_type"), F.replace("e.expression", F.lit(" "), F.lit("")).alias("expression"), "e.kind")
    callee = F.substring_index("expression", ".", -1)
    rows = rows.withColumn("callee", callee).withColumn("qualifier", F.when(F.contains(F.col("expression"), F.lit(".")), F.regexp_extract("expression", r"(\w+)\.\w+$", 1)).otherwise(""))
    return rows.where(~F.lower("callee").isin(diff.KEYWORDS) & ~F.lower("callee").isin("nameof", "typeof", "sizeof", "default", "lock")).select("path", "line", "caller", "own_type", "expression", "qualifier", "callee", "kind")


def resolved(found: DataFrame, methods: DataFrame) -> DataFrame:
    """calls with callee_id and how they are made: to the type that is named (or constructed), else to a method of the
    caller's own type, else to every method of that name. Both sides are as large as the code, however small the plan takes
    them for, so neither is broadcast; each is written once and read by the three joins."""
    known = methods.select(F.col("method_id").alias("callee_id"), F.col("type").alias("to_type"), F.col("name").alias("callee"), "static", "virtual", "extension", F.col("kind").alias("to_kind")).distinct()
    known = cut(known)
    named = F.when(F.col("kind") == "Constructor", F.col("callee")).when(F.col("qualifier").isin("", "this", "base"), F.col("own_type")).otherwise(F.col("qualifier"))
    asked = cut(found.select("path", "line", "caller", "callee", "kind", named.alias("to_type")).join(known.select("callee").distinct().hint("merge"), "callee", "left_semi"))
    exact = asked.join(known.hint("merge"), ["to_type", "callee"])
    missed = asked.where("kind != 'Constructor'").join(known.select("to_type", "callee").distinct().hint("merge"), ["to_type", "callee"], "left_anti").drop("to_type")
    wide = missed.join(known.hint("merge"), "callee")
    both = exact.unionByName(wide.select(*exact.columns))
    how = classify.call_type(F.col("extension"), F.col("static"), F.col("virtual"), F.col("to_kind") == "interface")
    return both.select("path", "line", "caller", "callee_id", "kind", how.alias("call_type"))


def overrides(files: DataFrame) -> DataFrame:
    """base, impl: methods of a type that have the name of one of a type it is derived from."""
    return _overrides(cut(declarations(files)))


def _overrides(found: DataFrame) -> DataFrame:
    above = _types(found).select("type", F.explode("bases").alias("base_type")).distinct()
    own = _declared(found).select("method_id", "type", "name").distinct()
    impl = own.join(above.hint("merge"), "type").select(F.col("method_id").alias("impl"), "name", F.col("base_type").alias("type"))
    return impl.join(own.withColumnRenamed("method_id", "base").hint("merge"), ["type", "name"]).select("base", "impl").distinct()


def call_graph(files: DataFrame, polymorphic: bool = True) -> DataFrame:
    """caller, callee between declared methods; with both ways between a method and what overrides or implements it."""
    found = cut(declarations(files))  # the text is read twice: for this, and for the calls
    edges = resolved(calls(files), _declared(found)).select("caller", F.col("callee_id").alias("callee")).distinct()
    return with_overrides(edges, _overrides(found)) if polymorphic else edges


def type_usage(files: DataFrame) -> DataFrame:
    """type, path, line, declares: where the declared types are named."""
    known = types(files).select("type").distinct()
    lines = code_lines(files).withColumn("own", F.when(F.col("declares_type"), F.col("type")))
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z]\w*)\b"), F.lit(1))))
    return lines.select("path", "line", "own", words.alias("type")).join(known.hint("merge"), "type").select("type", "path", "line", F.coalesce(F.col("own") == F.col("type"), F.lit(False)).alias("declares"))


# Tests


def marked(files: DataFrame) -> DataFrame:
    """path, namespace, type, method (null for the type itself), attributes (name, value): what stands in brackets between
    the declaration before and this one, or on its line."""
    declares = lambda x: x["own_t"] | F.coalesce(x["own_m"] & (x["t"]["at"] <= x["m"]["at"]), F.lit(False))
    own = marks_of_lines(files).select("path", "texts", F.filter("marks", declares).alias("marks"))
    since = lambda k: F.when(k == 0, 0).otherwise(F.get("marks", k - 1)["n"] + 1)
    pieces = F.transform("marks", lambda x, k: F.struct(x.alias("mark"), F.slice("texts", since(k) + 1, x["n"] - since(k) + 1).alias("texts")))
    rows = own.select("path", F.explode_outer(pieces).alias("p")).select("path", "p.texts", *_facts(F.col("p.mark"))).where("type is not null")
    clean = lambda v: F.nullif(F.regexp_replace(F.trim(v), r'^"|"$', ""), F.lit(""))
    full = lambda a: F.when(F.lower(a).endswith("attribute"), a).otherwise(F.concat(a, F.lit("Attribute")))
    in_line = lambda x: F.zip_with(F.regexp_extract_all(x, F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all(x, F.lit(ATTRIBUTE), F.lit(2)), lambda a, v: F.struct(full(a).alias("name"), clean(v).alias("value")))
    some = F.concat(F.filter(F.slice("texts", 1, F.size("texts") - 1), lambda x: F.trim(x).startswith("[")), F.slice("texts", -1, 1))
    return rows.select("path", "namespace", "type", F.when(F.col("declares_method"), F.col("method")).alias("method"), F.flatten(F.transform(some, in_line)).alias("attributes"))


def fixtures(files: DataFrame) -> DataFrame:
    """path, fixture, tests, setups: types that are marked as fixtures or hold test methods, if they hold tests or what sets
    them up or tears them down."""
    rows = marked(files).withColumn("fixture", qualified(F.col("namespace"), F.col("type"))).withColumn("names", F.transform("attributes", lambda a: a["name"]))
    around = attributes.any_marks(F.col("names"), "setup", "teardown", "setup_once", "teardown_once")
    found = rows.groupBy("path", "fixture").agg(
        F.coalesce(F.bool_or(F.col("method").isNull() & attributes.any_marks(F.col("names"), "fixture")), F.lit(False)).alias("named"),
        F.count_if(F.col("method").isNotNull() & attributes.is_executable(F.col("names"))).alias("tests"), F.count_if(F.col("method").isNotNull() & around).alias("setups"),
    )
    return found.where("tests + setups > 0").drop("named")


def discovered(files: DataFrame) -> DataFrame:
    """test_id, path, fixture, name, categories, cases: the tests of all fixtures."""
    rows = marked(files).where("method is not null").withColumn("names", F.transform("attributes", lambda a: a["name"])).where(attributes.is_executable(F.col("names")))
    fixture = qualified(F.col("namespace"), F.col("type"))
    return rows.select(F.concat_ws(".", fixture, "method").alias("test_id"), "path", fixture.alias("fixture"), F.col("method").alias("name"), attributes.values_of(F.col("attributes"), "category").alias("categories"), attributes.values_of(F.col("attributes"), "case").alias("cases"))


def discovery_results(files: DataFrame) -> DataFrame:
    """path, fixtures, tests, error for every file, also those without tests or content."""
    found = fixtures(files).groupBy("path").agg(F.count("*").alias("fixtures"), F.sum("tests").alias("tests"))
    error = F.when(F.col("content").isNull(), "no content")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.select("path", error.alias("error")).join(found.hint("merge"), "path", "left").select("path", zero("fixtures"), zero("tests"), "error")


def discovery_summary(results: DataFrame) -> DataFrame:
    """One row: files, those that were read and those that weren't, fixtures, tests."""
    return results.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("read"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("fixtures"), F.lit(0)).alias("fixtures"), F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"))


def is_test(attributes_: Column, name: Column, class_: Column, path: Column, rule: str = "graph") -> Column:
    """Whether a method is a test, by one of the three rules that are in use: `graph` goes by attributes, the method's and
    the class's name, `incremental` not by the class's, and `source` by attributes or, in a test path, the name's words."""
    marks = F.coalesce(F.exists(attributes_, lambda a: a.rlike("(?i)(test|testmethod|fact|theory)(attribute)?$")), F.lit(False))
    ends = lambda c: F.coalesce(c.rlike("(?i)tests?$"), F.lit(False))
    if rule == "source":
        return marks | (names.contains_any(path, ["test"]) & names.contains_any(name, ["test", "should"]))
    return marks | ends(name) | (ends(class_) if rule == "graph" else F.lit(False))
