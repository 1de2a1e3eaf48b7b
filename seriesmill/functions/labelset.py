"""Label sets as MAP<STRING, STRING>: a missing label and an empty one are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

MAP = "map<string,string>"


def empty() -> Column:
    return F.create_map().cast(MAP)


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def from_pairs(entries: Column) -> Column:
    """A map of an array of (name, value); the last of equal names wins."""
    start = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(entries, start, lambda m, e: put(m, e[_field(entries, 0)], e[_field(entries, 1)]))


def _field(_: Column, k: int) -> str:
    return ("name", "value")[k]


def canonical(m: Column) -> Column:
    """`name:value;` of each label, by name; nothing is escaped."""
    return F.concat_ws("", F.transform(sorted_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit(";"))))


def get(m: Column, name: Column | str, default: str = "") -> Column:
    key = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def length(m: Column) -> Column:
    return F.size(m)


def is_empty(m: Column) -> Column:
    return F.size(m) == 0


def name_at(m: Column, k: int) -> Column:
    """The k-th name in order, from 0; null beyond the end."""
    return F.get(sorted_entries(m), k)["key"]


def value_at(m: Column, k: int) -> Column:
    return F.get(sorted_entries(m), k)["value"]


def put(m: Column, name: Column, value: Column) -> Column:
    """With name set to value, whatever it is."""
    return bind(name, lambda n: F.map_concat(F.map_filter(m, lambda k, _: k != n), F.create_map(n, value)))


def set_label(m: Column, name: Column, value: Column) -> Column:
    """With name set to value; an empty value deletes it. m, name and value are in the result once each."""
    given = F.struct(name.alias("name"), value.alias("value"))
    added = lambda e: F.map_filter(F.create_map(e["name"], e["value"]), lambda _, v: v != "")
    return bind(given, lambda e: F.map_concat(F.map_filter(m, lambda k, _: k != e["name"]), added(e)))


def with_label(m: Column, name: str, value: str) -> Column:
    return put(m, F.lit(name), F.lit(value))


def merge(a: Column, b: Column) -> Column:
    """Labels of both; b's values win."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def without(m: Column, names: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(names)) if names else m


def only(m: Column, names: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(names))


def split_by(m: Column, names: list[str]) -> tuple[Column, Column]:
    return only(m, names), without(m, names)


def has(m: Column, name: str) -> Column:
    return get(m, name) != ""


def without_empty(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v != "")


def has_duplicate_names(names: Column) -> Column:
    return F.size(names) != F.size(F.array_distinct(names))


def to_json(m: Column) -> Column:
    """A JSON object, by name."""
    return F.to_json(F.map_from_entries(sorted_entries(m)))


def from_json(text: Column) -> Column:
    return F.from_json(text, MAP)


def to_yaml(m: Column) -> Column:
    """A YAML mapping with quoted scalars, by name."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    quote = lambda c: F.concat(F.lit('"'), escaped(c), F.lit('"'))
    return F.concat_ws("", F.transform(sorted_entries(m), lambda e: F.concat(quote(e["key"]), F.lit(": "), quote(e["value"]), F.lit("\n"))))


#: A line of a YAML mapping: a name and a value, each plain or in single or double quotes, and a comment.
SCALAR = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^']*+(?:''[^']*+)*+'|[^\s"'#:,\[\]{}&*!|>%@`](?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t](?=[^\s#]))*+)"""
YAML_LINE = rf"^({SCALAR})[ \t]*:(?:[ \t]+({SCALAR}))?[ \t]*(?:(?<=\s)#.*)?\z"


def _scalar(text: Column) -> Column:
    """The string of a YAML scalar."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    part = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    double = F.array_join(F.transform(F.split(inner, r"\\\\"), part), "\\")
    single = F.replace(inner, F.lit("''"), F.lit("'"))
    return F.when(text.startswith('"'), double).when(text.startswith("'"), single).otherwise(text)


def from_yaml(text: Column) -> Column:
    """The map of a YAML mapping of scalars, a label on a line; a scalar is plain or quoted, a missing value empty.

    Empty lines, comments and the marks of a document's start and end are skipped, and {} is the empty
    map. A line that is no label, or a name that comes twice, makes the result null, as an unreadable JSON
    text does.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(r"^\s*(?:#.*)?\z|^(?:---|\.\.\.)\s*\z"))

    def mapping(kept: Column) -> Column:
        entries = F.transform(kept, lambda x: F.struct(_scalar(F.regexp_extract(x, YAML_LINE, 1)).alias("key"), _scalar(F.regexp_extract(x, YAML_LINE, 2)).alias("value")))
        unique = lambda e: F.when(F.size(F.array_distinct(F.transform(e, lambda x: x["key"]))) == F.size(e), F.map_from_entries(e))
        return F.when(F.forall(kept, lambda x: x.rlike(YAML_LINE)), bind(entries, unique))

    return F.when(F.trim(text) == "{}", empty()).otherwise(bind(lines, mapping))
