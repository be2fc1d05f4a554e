"""Reading schemaless documents held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(name: str) -> str:
    return name if name.startswith("$") else "$." + name


def get(doc: Column | str, name: str, kind: str = "string") -> Column:
    """Value at a dotted name, null when absent or of another kind."""
    return F.try_variant_get(doc, path_of(name), kind)


def present(doc: Column | str, name: str) -> Column:
    """True when the key is there, JSON null included."""
    return F.try_variant_get(doc, path_of(name), "variant").isNotNull()


def is_null_leaf(doc: Column | str, name: str) -> Column:
    """True when the key is there and holds JSON null."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(doc, path_of(name), "variant")) == "VOID",
                      F.lit(False))


def text(doc: Column | str, name: str) -> Column:
    """Value at a name only if it is a string (an object would become its JSON text)."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path_of(name), "variant"))
    return F.when(kind == "STRING", get(doc, name))


def first(doc: Column | str, names: str, kind: str = "string") -> Column:
    """First non-null of several comma-separated dotted names."""
    return F.coalesce(*[get(doc, n, kind) for n in names.split(",")])


def get_or(doc: Column | str, name: str, default, kind: str = "string") -> Column:
    """Value at a name; the default when a key is missing or a step above the leaf is
    null. A leaf that is null stays null."""
    return F.when(present(doc, name), get(doc, name, kind)).otherwise(F.lit(default))


def first_or(doc: Column | str, names: str, default, kind: str = "string") -> Column:
    """The first name whose key is there with a value, else the default."""
    return F.coalesce(first(doc, names, kind), F.lit(default))


def last_segment(url: Column | str) -> Column:
    """Last part of a URL path as a number."""
    return F.try_element_at(F.split(url, "/"), F.lit(-1)).try_cast("int")
