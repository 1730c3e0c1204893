"""Filters, orderings and pages of a search."""

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from folioseek.operators.postings import name_key, path_key

# Sort names and the column each stands for; "score" is handled by the search.
SORTS = ("score", "file_name", "file_path", "file_size", "file_type", "modified_at", "created_at")


@dataclass(frozen=True)
class Filters:
    """What a hit must satisfy besides the text. Unset parts do not filter.

    Both ends of a range count. An empty `file_type` is unset; a size of 0 is a
    bound.
    """

    file_type: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    modified_from: datetime | str | None = None
    modified_to: datetime | str | None = None
    created_from: datetime | str | None = None
    created_to: datetime | str | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)

    def on_file(self) -> list[Column]:
        """Conditions on columns that postings carry too."""
        found = []
        if self.file_type:
            found.append(F.col("file_type") == self.file_type)
        if self.min_size is not None:
            found.append(F.col("file_size") >= self.min_size)
        if self.max_size is not None:
            found.append(F.col("file_size") <= self.max_size)
        for name in ("modified", "created"):
            column = F.col(f"{name}_at")
            start, end = getattr(self, f"{name}_from"), getattr(self, f"{name}_to")
            if start is not None:
                found.append(column >= F.lit(start).cast("timestamp"))
            if end is not None:
                found.append(column <= F.lit(end).cast("timestamp"))
        return found

    def on_metadata(self) -> list[Column]:
        """Conditions only the documents table can answer."""
        return [F.col("metadata")[key] == value for key, value in self.metadata.items()]

    def __bool__(self) -> bool:
        return bool(self.on_file() or self.on_metadata())


def keep_if(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    for condition in conditions:
        rows = rows.filter(condition)
    return rows


def ordering(sort_by: str, sort_order: str, keys: tuple[str, ...] = ()) -> list[Column]:
    """Missing values come last either way; ties go by path."""
    if sort_by not in SORTS:
        raise ValueError(f"cannot sort by {sort_by!r}; known: {SORTS}")
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order must be 'asc' or 'desc'")
    keys_of = {"file_name": name_key, "file_path": path_key}
    column = keys_of.get(sort_by, lambda c: c)(F.col(sort_by))
    first = column.desc_nulls_last() if sort_order == "desc" else column.asc_nulls_last()
    return [*map(F.asc, keys), first, F.asc("file_path")]


def after_hit(sort_by: str, sort_order: str, after: tuple) -> Column:
    """Rows that follow a hit in an order; `after` holds its sort value and path."""
    value, path = after
    column = {"file_name": name_key, "file_path": path_key}.get(sort_by, lambda c: c)(F.col(sort_by))
    later = F.col("file_path") > path
    if value is None:
        return column.isNull() & later
    known = F.lit(value)
    beyond = column < known if sort_order == "desc" else column > known
    return beyond | column.isNull() | ((column == known) & later)


def window_of(
    size: int | None, page: int | None, page_size: int | None
) -> tuple[int, int | None]:
    """(rows to skip, rows to return or None for all); pages count from 1."""
    count = size if page_size is None else page_size
    if page is not None and count is None:
        raise ValueError("a page needs a page_size or a size")
    offset = 0 if page is None else (page - 1) * count
    if offset < 0 or (count is not None and count < 0):
        raise ValueError("size, page_size and page must not be negative")
    return offset, count


def top(
    rows: DataFrame, order: list[Column], offset: int = 0, count: int | None = None
) -> DataFrame:
    if count is None:
        return rows
    ordered = rows.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(count)
