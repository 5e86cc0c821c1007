"""Scalar functions over text, times and lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The time formats that source records use, tried in order.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]['Z']", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "dd-MMM-yyyy hh:mm:ss a")


def coerce_time(value: Column) -> Column:
    """A UTC time in whole seconds, or null; text without a zone is UTC."""
    text = F.nullif(F.trim(value), F.lit(""))
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))
    return F.date_trunc("second", parsed)


def one_line(value: Column) -> Column:
    """Runs of white space as one space, trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def trim_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def feature_hash(value: Column) -> Column:
    """CT and twelve hex digits of the lower-cased, trimmed text; blank is null."""
    text = trim_or_null(F.lower(value))
    return F.when(text.isNotNull(), F.concat(F.lit("CT"), F.substring(F.sha2(text, 256), 1, 12)))


def bucket_hash(value: Column, prefix: str, buckets: int = 10000) -> Column:
    """prefix and the first 16 hex digits of the text's digest modulo buckets, zero-padded."""
    number = F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.concat(F.lit(prefix), F.lpad((number % buckets).cast("int").cast("string"), len(str(buckets - 1)), "0"))


def node_id(tree: str | Column, source: Column) -> Column:
    return F.concat_ws(":", F.lit(tree) if isinstance(tree, str) else tree, source.cast("string"))


def source_id(node: Column) -> Column:
    return F.substring_index(node, ":", -1)


def zipped(*columns: Column) -> Column:
    """Structs of comma-separated lists side by side, as many as the shortest has; parts are trimmed."""
    lists = [F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)) for c in columns]
    names = [f"part{i}" for i in range(len(columns))]
    size = F.least(*(F.size(x) for x in lists)) if len(lists) > 1 else F.size(lists[0])
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(*(F.get(x, i).alias(n) for x, n in zip(lists, names))))


def name_set(value: Column) -> Column:
    """An order-free form of a list of names."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(value, lambda x: F.trim(x)), lambda x: x != "")))


def tokens(value: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of two or more ASCII letters and digits, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


#: Accented Latin letters and what they are without accents.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def folded(value: Column) -> Column:
    """The text without the accents of Latin letters."""
    return F.translate(value, ACCENTED, PLAIN)


def compact_list(value: Column) -> Column:
    """A list without nulls; null is empty."""
    return F.coalesce(F.array_compact(value), F.array().cast("array<string>"))


def title(value: Column) -> Column:
    """Each word with a capital first letter, the rest in lower case."""
    return F.initcap(F.trim(value))


def dispatched_cast(value: Column) -> Column:
    """A date from a text in one of two forms (yyyy-MM-dd, or dd-MMM-yyyy), chosen by pattern; null for others."""
    iso, named = value.rlike(r"^\d{4}-\d{2}-\d{2}"), value.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$")
    return F.when(iso, F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")).when(named, F.try_to_date(value, "d-MMM-yyyy"))


def canonical_value(json: Column) -> Column:
    """A type-tagged key of a JSON value, equal for equal values: numbers by value, objects with sorted keys, null for what isn't JSON."""
    v = F.try_parse_json(json)
    kind = F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    number = F.try_variant_get(v, "$", "double")
    text = F.when(kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.concat(F.lit("number:"), number.cast("string")))
    text = text.when(kind == "STRING", F.concat(F.lit("string:"), F.try_variant_get(v, "$", "string")))
    text = text.when(kind == "BOOLEAN", F.concat(F.lit("boolean:"), F.try_variant_get(v, "$", "string"))).when(kind == "VOID", "null")
    return F.when(v.isNotNull(), text.otherwise(F.concat(F.lower(kind), F.lit(":"), F.to_json(v))))


def yes_if(value: Column) -> Column:
    """yes where there is a text that isn't blank, else no."""
    return F.when(F.coalesce(F.trim(value) != "", F.lit(False)), "yes").otherwise("no")


def pick(catalogue: Column, seed: Column) -> Column:
    """The entry of a sorted list that a seed falls on; null for an empty list."""
    return F.when(F.size(catalogue) > 0, F.try_element_at(catalogue, (F.pmod(seed, F.greatest(F.size(catalogue), F.lit(1))) + 1).cast("int")))


def uuid5(value: Column, namespace: str) -> Column:
    """The name-based identifier (version 5) of a text under a namespace."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(value, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
