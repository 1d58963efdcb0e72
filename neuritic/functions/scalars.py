"""Scalar expressions on names, paths, labels and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_share(name: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 that follows from seed and name alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def in_test(name: Column, share: float = 0.2, seed: int = 42) -> Column:
    """Whether a file belongs to the test part of a split."""
    return hash_share(name, seed) < share


def slug(text: Column) -> Column:
    """Text fit for a file name; `na` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(kept == "", "na").otherwise(kept)


def benchmark_id(cell_type: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", cell_type, number)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def source_of(name: Column) -> Column:
    """The source in front of `__` in a file name, `other` if there is none."""
    head = F.substring_index(F.lower(name), "__", 1)
    return F.when(F.instr(name, "__") > 0, head).otherwise("other")


def verdict_class(verdict: Column) -> Column:
    return F.trim(F.substring_index(verdict, " — ", 1))


def cell_type_hint(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("pyramidal"), "pyramidal").when(low.contains("interneuron"), "interneuron")


def safe_div(a: Column, b: Column, default: float = 0.0, eps: float = 0.0) -> Column:
    """a / b, or the default where b is not above eps."""
    return F.when(F.abs(b) > eps, a / b).otherwise(F.lit(default))


def finite(x: Column) -> Column:
    """The number, 0 where it is none or not finite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def rounded(x: Column, digits: int = 4) -> Column:
    """A number for reports, halves to even."""
    return F.bround(x, digits)


def clean_name(name: Column) -> Column:
    """A downloaded file's name without separators."""
    return F.translate(name, "; /", "___")


def is_error_page(body: Column) -> Column:
    return F.contains(F.lower(F.substring(body, 1, 200)), F.lit("<html"))


def dendrite_class(dendrite_type: Column) -> Column:
    """Cell type by kind of dendrite."""
    return F.when(dendrite_type == "spiny", "pyramidal").when(dendrite_type.isin("aspiny", "sparsely spiny"), "interneuron")


def canonical_labels(cell_type: Column, types: Column) -> Column:
    """Whether a cell's labels are a full set for its type."""
    key = F.array_join(F.sort_array(types), "")
    return ((cell_type == "pyramidal") & key.isin("123", "1234")) | ((cell_type == "interneuron") & key.isin("12", "13", "123"))


def holds_labels(types: Column, required: tuple) -> Column:
    """Whether a set of labels holds all of these."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), types)) == 0


def neurite_labels(types: Column) -> Column:
    """A set of labels without soma, in order."""
    return F.sort_array(F.array_except(types, F.array(F.lit(1))))
