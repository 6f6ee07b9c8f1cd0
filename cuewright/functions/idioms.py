"""Column builders for the value idioms of event-driven control code.

Three ways of treating a missing value look alike and are not:

* ``nullish`` takes the next value only for null;
* ``truthy_text`` and ``truthy_number`` also skip ``''``, and 0 and NaN;
* ``absent_default`` is a default for an absent field; with a typed
  column absent and null are one, so it equals ``nullish`` and is kept apart for its meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nullish(*values: Column) -> Column:
    return F.coalesce(*values)


def truthy_text(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def truthy_number(*values: Column) -> Column:
    """The first that is neither null, 0 nor NaN."""
    return F.coalesce(*[F.when(F.isnan(v) | (v == 0), None).otherwise(v) for v in values])


def absent_default(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)


def to_boolean(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def to_number(text: Column) -> Column:
    """The number that a text holds, or 0."""
    return F.coalesce(F.nanvl(text.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def half_up(x: Column) -> Column:
    """The nearest integer, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def bar_width(length: Column) -> Column:
    """Percent of a row: five for each unit, 100 at most; no lower bound."""
    return F.least(F.lit(100.0), length * F.lit(5.0))


def clamp(i: Column, n: Column) -> Column:
    """An index moved into 0 to n - 1."""
    return F.greatest(F.lit(0), F.least(n - 1, i))


def hash_bucket(x: Column, n: Column) -> Column:
    """A bucket from 0 to n - 1 for a number; null when there are none."""
    return F.when(n > 0, (F.abs(half_up(x)) % n).cast("int"))


def module_chunk(path: Column, marker: str = "node_modules/") -> Column:
    """The name of the directory after a marker, or null."""
    return F.when(F.contains(path, F.lit(marker)), F.split_part(F.split_part(path, F.lit(marker), F.lit(2)), F.lit("/"), F.lit(1)))


def variant(variants: Column, name: Column, default: str = "default") -> Column:
    """A map's value for a name, or that of the default variant."""
    return F.coalesce(F.try_element_at(variants, name), F.try_element_at(variants, F.lit(default)))


def overlay(left: Column, right: Column) -> Column:
    """Two maps as one; keys of the right one win, with null values too, and a null map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    l, r = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(l, lambda k, _: ~F.map_contains_key(r, k)), r)


def kind_of(json: Column) -> Column:
    """number, string, object or other, for JSON text; other where it does not parse."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(kind == "STRING", "string").when(kind.startswith("OBJECT"), "object").otherwise("other")
