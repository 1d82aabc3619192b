"""Findings as arrays in a page's row: what detectors share. Nothing here moves rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import sql_of


def of(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def literal(kinds: str, values: Iterable) -> str:
    """SQL of a struct of values; kinds as in "a bigint, b string". Plans are built of text where rules make them long:
    each call that makes a column costs about a millisecond."""
    fields = [f.strip().split(" ", 1) for f in kinds.split(", ")]
    return "named_struct(" + ", ".join(f"'{n}', CAST({sql_of(v)} AS {k})" for (n, k), v in zip(fields, values, strict=True)) + ")"


def literal_rows(rows: Iterable[Iterable], kinds: str) -> Column:
    """An array of structs."""
    found = [literal(kinds, r) for r in rows]
    kind = ",".join(":".join(f.strip().split(" ", 1)) for f in kinds.split(", "))
    return F.expr("array(" + ", ".join(found) + ")") if found else F.array().cast(f"array<struct<{kind}>>")


def matching(tests: Iterable[tuple[str, str]], kind: str) -> Column:
    """Of (SQL condition, SQL value), the values whose condition holds, in an array."""
    cases = ", ".join(f"CASE WHEN {test} THEN {value} END" for test, value in tests)
    return F.expr(f"filter(array({cases}), x -> x IS NOT NULL)") if cases else F.array().cast(f"array<{kind}>")


def listed(items: Iterable[Column], kind: str) -> Column:
    """An array of structs of a kind, also of none."""
    items = list(items)
    return F.array(*items) if items else F.array().cast(f"array<{kind}>")


def where_true(*tests: tuple[Column, Column]) -> Column:
    """The findings whose condition holds."""
    return F.filter(F.array(*(F.when(test, made) for test, made in tests)), lambda x: x.isNotNull())


def first_of_each(found: str, key: Callable[[Column], Column]) -> Column:
    """The elements of an array column that are the first with their key: sorted by key and place, heads kept, put back in order."""
    placed = F.transform(found, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    heads = F.transform(F.array(F.array_sort(placed)), lambda s: F.filter(s, lambda r, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(r["k"])))[0]
    back = F.array_sort(F.transform(heads, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
    return F.transform(back, lambda r: r["x"])


def exploded(df: DataFrame, found: Column) -> DataFrame:
    """A row for each finding. Outer, then filtered: of a plain explode the optimizer infers a filter on the array's size and
    pushes it, with all of the detectors in it, below the steps that compute the array."""
    return df.select("scan_id", F.explode_outer(found).alias("f")).where("f is not null").select("scan_id", "f.*")


def pattern(text: str, ignore_case: bool) -> str:
    return ("(?iuU)" if ignore_case else "(?U)") + text


def any_of(text: Column | str, words: Iterable[str]) -> Column:
    """Whether a text, or the column of that name, holds any of the words."""
    if isinstance(text, str):
        return F.expr(" OR ".join(f"contains({text}, {sql_of(w)})" for w in words) or "FALSE")
    return F.exists(F.expr(f"CAST({sql_of(tuple(words))} AS array<string>)"), lambda w: F.contains(text, w))
