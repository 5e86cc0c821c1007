"""Validation and building of edges from source records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of each rule that a row breaks (a rule is true on a valid row; null is broken)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def missing_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)), column, "left_anti")


def unlinked(rows: DataFrame, column: str, field: str) -> DataFrame:
    """rows with linked and unlinked: the parts of an array of structs with and without an id."""
    return rows.withColumns({"linked": F.filter(column, lambda x: x[field].isNotNull()), "unlinked": F.filter(column, lambda x: x[field].isNull())})


def build_edges(rows: DataFrame, key: str, column: str, field: str) -> DataFrame:
    """key, target, position: one edge for each target of a row, the first of repeats."""
    each = rows.select(key, F.posexplode(column).alias("position", "x")).select(key, F.col(f"x.{field}").alias("target"), "position")
    return each.where(F.col("target").isNotNull()).groupBy(key, "target").agg(F.min("position").alias("position"))


def payload_filter(text: str, payload: str = "payload", ids: str = "id") -> Column:
    """A filter of ``key:value`` tokens, all of which must hold: null, empty, ~word (contains), id:a,b, or a value."""
    conditions = [F.lit(True)]
    for token in text.split():
        key, _, value = token.partition(":")
        field = F.get_json_object(payload, f"$.{key}")
        if key == "id":
            conditions.append(F.col(ids).cast("string").isin(*value.split(",")))
        elif value == "null":
            conditions.append(field.isNull())
        elif value == "empty":
            conditions.append(F.coalesce(field, F.lit("")).isin("", "[]"))
        elif value.startswith("~"):
            conditions.append(field.contains(value[1:]))
        else:
            conditions.append(field == value)
    return reduce(lambda a, b: a & b, conditions)


def last_row(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


@dataclass(frozen=True)
class RecordRules:
    """What a line of JSON is to be.

    fields: the kind of each field: string, boolean, strings (a list without nulls)
    or entries (a list of objects); a ? after it allows null.  Every field is to be
    there, and no other.  nested: the fields of each list of objects, all texts or
    null, one at least not null.  parallel: pairs of lists of one length.
    """

    key: str
    fields: dict[str, str]
    pattern: str
    parent: str | None = None
    nested: dict[str, Sequence[str]] = field(default_factory=dict)
    parallel: Sequence[tuple[str, str]] = ()


_FOUND = "array<struct<rule:string,field:string>>"


def _found(rule: str, name: str, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("field")))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _is(value: Column, kind: Column, wanted: str) -> Column:
    plain = wanted.rstrip("?")
    if plain == "strings":
        ok = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(_as(value, "array<string>"), lambda x: x.isNull())
    elif plain == "entries":
        ok = kind.startswith("ARRAY<OBJECT") | (kind == "ARRAY<VOID>")
    else:
        ok = kind == {"string": "STRING", "boolean": "BOOLEAN"}[plain]
    return F.coalesce(ok | (kind == "VOID") if wanted.endswith("?") else ok, F.lit(False))


def _bad_entries(value: Column, kind: Column, inner: Sequence[str]) -> Column:
    """Whether a list of objects has one with other fields, other types, or nothing but nulls."""

    def bad(x: Column) -> Column:
        typed, some = F.forall(x["kinds"], lambda k: k.isin("STRING", "VOID")), F.array_contains(x["kinds"], "STRING")
        return F.coalesce(~typed | ~some | (F.array_sort(x["keys"]) != F.array(*map(F.lit, sorted(inner)))), F.lit(True))

    each = F.transform(_as(value, "array<map<string,variant>>"), lambda x: F.struct(F.map_keys(x).alias("keys"), F.transform(F.map_values(x), F.schema_of_variant).alias("kinds")))
    return kind.startswith("ARRAY<OBJECT") & F.exists(each, bad)


def record_violations(lines: DataFrame, rules: RecordRules) -> DataFrame:
    """line, key, rule, field: all that is wrong with records (line, value: a JSON text each; blank ones are left out).

    Rules: json, missing, unknown, type, pattern, parent, entry, parallel, duplicate
    and reference (a parent that no record is).  A record that isn't an object only has json.
    """
    parsed = lines.where(F.trim("value") != "").select("line", F.try_parse_json("value").alias("v"))
    names = {name: f"k{i}" for i, name in enumerate(dict.fromkeys([*rules.fields, rules.key, *([rules.parent] if rules.parent else []), *rules.nested]))}

    def every(x: Column) -> Column:
        m, kind = x["m"], lambda name: x[names[name]]
        has = lambda name: F.map_contains_key(m, name)
        broken = [_found("missing", name, ~has(name)) for name in rules.fields]
        broken += [_found("type", name, has(name) & ~_is(m[name], kind(name), wanted)) for name, wanted in rules.fields.items()]
        for rule, name in (("pattern", rules.key), ("parent", rules.parent)):
            if name:
                broken.append(_found(rule, name, (kind(name) == "STRING") & ~_as(m[name], "string").rlike(rules.pattern)))
        broken += [_found("entry", name, _bad_entries(m[name], kind(name), inner)) for name, inner in rules.nested.items()]
        broken += [_found("parallel", a, F.size(_as(m[a], "array<string>")) != F.size(_as(m[b], "array<string>"))) for a, b in rules.parallel]
        others = F.array_except(F.map_keys(m), F.array(*map(F.lit, rules.fields)))
        unknown = F.coalesce(F.transform(others, lambda y: F.struct(F.lit("unknown").alias("rule"), y.alias("field"))), F.array().cast(_FOUND))
        return F.when(m.isNotNull(), F.concat(F.array_compact(F.array(*broken)), unknown)).otherwise(F.array(F.struct(F.lit("json").alias("rule"), F.lit("").alias("field"))))

    # A record's fields and their kinds are made once, and the rules are a lambda over them: all rules in one
    # generated method would be too long for the JVM to compile.
    whole = parsed.select("line", _as(F.col("v"), "map<string,variant>").alias("m"))
    facts = F.struct("m", *(F.schema_of_variant(F.col("m")[name]).alias(k) for name, k in names.items()))
    own = whole.select("line", _as(F.col("m")[rules.key], "string").alias("key"), F.inline(F.flatten(F.transform(F.array(facts), every))))
    # fields of an object only: a path finds none in other values; a filter on what inline gives doesn't go below it and parse again
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string") if name else F.lit(None).cast("string")
    keys = parsed.select("line", F.inline(F.array(F.struct(text(rules.key).alias("key"), text(rules.parent).alias("up"))))).where("key IS NOT NULL")
    first = keys.groupBy("key").agg(F.min("line").alias("first"), F.lit(True).alias("known"))
    named = keys.select("line", "key", F.inline(F.array(F.struct(F.col("key").alias("k"), F.lit(False).alias("refers")), F.struct(F.col("up").alias("k"), F.lit(True).alias("refers"))))).where("k IS NOT NULL")
    met = named.join(first.withColumnRenamed("key", "k"), "k", "left").where(F.when(F.col("refers"), F.col("known").isNull()).otherwise(F.col("line") > F.col("first")))
    shown = lambda yes, no: F.when(F.col("refers"), yes).otherwise(no)
    return own.unionByName(met.select("line", "key", shown("reference", "duplicate").alias("rule"), shown(rules.parent or "", rules.key).alias("field")))
