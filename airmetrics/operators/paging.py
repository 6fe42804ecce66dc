"""exact pages at any depth, for any orderable key or list of keys.

The range of keys that holds the page is narrowed step by step: a few sampled keys split it, one aggregation
counts the rows of every part (a splitter's own key is a part of its own), and the part with the page's first row is split
again until few rows are left. Only the rows of that part are sorted; where the page reaches over its end, the next rows are a small top-k. Splitters decide the balance,
never the result. A step reads the key columns of the current range alone, with the bounds of the first key pushed to the
scan; each step divides the rows by about ``SPLITTERS``, so 10^11 rows take three steps.

Order: keys ascending, nulls first, NaN last; rows with equal keys by their other columns (those that can be
ordered), so pages do not overlap where keys repeat, and a key that fills a third of the table is split by these columns.
Rows equal in all of them are interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITTERS = 255
_GROUP = 16
BLOCK_ROWS = 100_000  # sorted as they are
TOP_ROWS = 10_000  # a page that ends here is a plain top-k


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType, T.CalendarIntervalType))


def total_order(df: DataFrame, keys: list[str]) -> list[str]:
    """``keys``, then the other columns that can be ordered."""
    return [*keys, *[f.name for f in df.schema.fields if f.name not in keys and _orderable(f.dataType)]]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _tuple(keys: list[str]) -> Column:
    return F.struct(*[_col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _literal(df: DataFrame, keys: list[str], row) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(f"k{i}") for i, (k, v) in enumerate(zip(keys, row, strict=True))])


def _plain(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.StructType))


def after(df: DataFrame, keys: list[str], row, also_equal: bool = False) -> Column:
    """Rows whose keys come after ``row`` (or equal it). The first key's bound is a condition of its own, for the scan."""
    k, r = _tuple(keys), _literal(df, keys, row)
    behind = k >= r if also_equal else k > r
    first = df.schema[keys[0]].dataType
    return behind if row[0] is None or not _plain(first) else (_col(keys[0]) >= F.lit(row[0]).cast(first)) & behind


def before(df: DataFrame, keys: list[str], row) -> Column:
    k, r = _tuple(keys), _literal(df, keys, row)
    first = df.schema[keys[0]].dataType
    if not _plain(first):
        return k < r
    bound = _col(keys[0]).isNull() if row[0] is None else _col(keys[0]).isNull() | (_col(keys[0]) <= F.lit(row[0]).cast(first))
    return bound & (k < r)


def equal(df: DataFrame, keys: list[str], row) -> Column:
    return reduce(lambda a, b: a & b, [_col(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType)) for k, v in zip(keys, row, strict=True)])


def _parts(df: DataFrame, keys: list[str], cuts: list[Row]) -> dict[int, int]:
    """Rows per part: part 2p holds the keys between the p-th and the next cut, part 2p - 1 the p-th cut's own key."""
    lits = [_literal(df, keys, c) for c in cuts]
    groups = F.array(*[F.array(*lits[a:a + _GROUP]) for a in range(0, len(lits), _GROUP)])
    rows = df.select(_tuple(keys).alias("k"))
    rows = rows.select("k", F.size(F.filter(F.array(*lits[::_GROUP]), lambda h: h <= F.col("k"))).alias("g"))
    rows = rows.select("k", "g", F.get(groups, F.col("g") - 1).alias("fine"))
    rows = rows.select("k", "g", "fine", F.when(F.col("g") > 0, F.size(F.filter("fine", lambda s: s <= F.col("k")))).otherwise(0).alias("j"))
    at = F.when(F.col("g") > 0, (F.col("g") - 1) * _GROUP + F.col("j")).otherwise(0)
    own = F.when(F.get("fine", F.col("j") - 1) == F.col("k"), 1).otherwise(0)
    return {r["part"]: r["count"] for r in rows.groupBy((at * 2 - own).alias("part")).count().collect()}  # at most 2 x splitters + 1


def page_at(df: DataFrame, keys: list[str], offset: int, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``offset`` + 1 ... ``offset`` + ``size`` in the order above."""
    rows = df.count()
    if offset >= rows or size < 1:
        return df.limit(0)
    order = total_order(df, keys)
    pieces = _narrow(df, list(keys), order, rows, offset, min(size, rows - offset), block_rows)
    return reduce(DataFrame.union, pieces).orderBy(*[_col(k) for k in order])


def _narrow(part: DataFrame, keys: list[str], order: list[str], rows: int, skip: int, size: int, block_rows: int) -> list[DataFrame]:
    """The page in pieces: from the part that holds its first row, and the top of what follows that part."""
    ordered = [_col(k) for k in order]
    if rows <= block_rows or skip + size <= TOP_ROWS:
        return [part.orderBy(*ordered).offset(skip).limit(size)]
    some = [_col(k) for k in keys]
    cuts = part.select(*some).orderBy(F.rand(rows % 9973)).limit(SPLITTERS).distinct().orderBy(*some).collect()
    counts = _parts(part, keys, cuts)
    ahead = 0
    for at in sorted(counts):
        if ahead + counts[at] > skip:
            break
        ahead += counts[at]
    here, held = min(size, ahead + counts[at] - skip), counts[at]
    if at % 2:  # a cut's own key: its rows are split by the further columns, or are all alike
        cut = cuts[(at - 1) // 2]
        inside = part.where(equal(part, keys, cut))
        out = [inside.limit(here)] if keys == order else _narrow(inside, order, order, held, skip - ahead, here, block_rows)
        rest = after(part, keys, cut)
    else:
        low, high = at // 2 - 1, at // 2
        inside = part if low < 0 else part.where(after(part, keys, cuts[low]))
        rest = None
        if high < len(cuts):
            inside, rest = inside.where(before(part, keys, cuts[high])), after(part, keys, cuts[high], also_equal=True)
        out = _narrow(inside, keys, order, held, skip - ahead, here, block_rows)
    if here < size:
        out.append(part.where(rest).orderBy(*ordered).limit(size - here))
    return out
