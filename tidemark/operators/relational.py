"""Small relational steps that many queries share: key lists, replaced columns, unnested JSON, pages, samples, merged lists, sets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are written into the plan itself; a longer list is joined.
MOST_LITERAL_KEYS = 1000

# The bounds of a page.
MOST_PER_PAGE, MOST_OFFSET = 100, 10_000


def by_keys(rows: DataFrame, columns: list[str], keys: DataFrame | Iterable[tuple]) -> DataFrame:
    """Rows whose ``columns`` are one of ``keys`` (tuples, or a table with these columns). Null keys match nothing; keys given twice count once."""
    if not isinstance(keys, DataFrame):
        listed = sorted({k for k in keys if None not in k}, key=str)
        if not listed:
            return rows.limit(0)
        if len(listed) <= MOST_LITERAL_KEYS:
            if len(columns) == 1:
                return rows.filter(F.col(columns[0]).isin([k[0] for k in listed]))
            # pruned by the first column, then told by all
            first = F.col(columns[0]).isin(sorted({k[0] for k in listed}))
            whole = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(columns, k, strict=True)]) for k in listed])
            return rows.filter(first & whole)
        types = dict(rows.dtypes)
        keys = rows.sparkSession.createDataFrame(listed, ", ".join(f"`{c}` {types[c]}" for c in columns))
    return rows.join(keys.select(*columns), columns, "left_semi")


def star_replace(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """All columns, some with another value, in place; a name that isn't there is an error."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"no column {missing[0]!r}")
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def unnest_json(rows: DataFrame, column: str, element: str, name: str = "item", *, keep_empty: bool = False) -> DataFrame:
    """A row for each element of a JSON list in ``column``; what is no list has none (with ``keep_empty``: one row, null)."""
    each = F.from_json(column, f"array<{element}>")
    return rows.withColumn(name, (F.explode_outer if keep_empty else F.explode)(each))


def ordering(by: list[tuple[str, str]]) -> list[Column]:
    """Columns with ``asc``, ``desc``, and where nulls go: ``asc nulls last`` and so on (nulls first by default)."""
    kinds = {"asc": F.asc_nulls_first, "desc": F.desc_nulls_first, "asc nulls last": F.asc_nulls_last, "desc nulls last": F.desc_nulls_last}
    return [kinds[how](c) for c, how in by]


def page(rows: DataFrame, by: list[tuple[str, str]], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` in order; both are held to the bounds of a page."""
    return rows.orderBy(*ordering(by)).offset(min(max(offset, 0), MOST_OFFSET)).limit(min(max(limit, 1), MOST_PER_PAGE))


def hashed_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``k`` rows by a hash of the key: always the same ones, and those of a smaller sample are among those of a larger one."""
    return rows.orderBy(F.sha1(F.col(key).cast("string")), key).limit(k)


def merge_sorted(lists: list[DataFrame], by: list[tuple[str, str]], k: int) -> DataFrame:
    """The first ``k`` rows of several lists together; each list gives its own first ``k`` at most."""
    order = ordering(by)
    return reduce(lambda a, b: a.unionByName(b), [x.orderBy(*order).limit(k) for x in lists]).orderBy(*order).limit(k)


def subset_of(items: Column, of: Column) -> Column:
    """Whether every element of one list is in the other; the empty list is in any."""
    return F.size(F.array_except(items, of)) == 0


def without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among the others'; rows with a null key stay."""
    return rows.join(others.select(*key), key, "left_anti")
