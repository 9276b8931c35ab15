"""Keys and casts: output stems, path parts, lenient numbers, seeded hash orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_stem(category: Column, stem: Column, classes: Sequence[str]) -> Column:
    """Category and stem, after one leading class name (of any case) is taken off the stem."""
    return F.concat(category, F.lit("_"), F.regexp_replace(stem, f"^(?i)({'|'.join(classes)})_", ""))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """File name, stem and suffix (with its dot, empty if none) of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return name, F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)


def number(text: Column, default: float | None = None) -> Column:
    """Text as a double; the default for what isn't a number, and for NaN."""
    x = text.try_cast("double")
    x = F.when(~F.isnan(x), x)
    return x if default is None else F.coalesce(x, F.lit(default))


def hash_order(seed: int, key: Column) -> Column:
    """A hex string that orders keys at random, the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def prefixed(df: DataFrame, prefix: str, *but: str) -> DataFrame:
    return df.select([F.col(c) if c in but else F.col(c).alias(prefix + c) for c in df.columns])


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the columns named that the table has; null if it has none."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None))
