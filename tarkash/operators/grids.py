"""Tables read from documents: grids of cells as array<array<string>> Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarkash.functions.text import bind


def clean_cells(grid: Column) -> Column:
    """Cells with white space collapsed; NULL cells are empty."""
    return F.transform(grid, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))


def drop_empty_rows(grid: Column) -> Column:
    return F.filter(grid, lambda r: F.exists(r, lambda c: c != ""))


def drop_empty_columns(grid: Column) -> Column:
    """Columns in which no row has text are left out; short rows count as blank there."""

    def run(grid: Column) -> Column:
        width = F.array_max(F.transform(grid, F.size))
        kept = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.exists(grid, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
        return F.when(F.size(grid) > 0, bind(kept, lambda k: F.transform(grid, lambda r: F.transform(k, lambda i: F.coalesce(F.get(r, i), F.lit("")))))).otherwise(grid)

    return bind(grid, run)


def is_legend(row: Column) -> Column:
    """Whether a row only numbers its columns (`1`, `2`, `4=2+3`); a row of one cell is none."""
    return (F.size(row) > 1) & F.forall(row, lambda c: (c == "") | c.rlike(r"^\(?\d+\)?(\s*=\s*[\d+\-()\s]+)?$")) & F.exists(row, lambda c: c != "")


def drop_legends(grid: Column) -> Column:
    return F.filter(grid, lambda r: ~is_legend(r))


def stitch_wrapped(grid: Column) -> Column:
    """Rows whose first cell is blank, and others not, are appended cell by cell to the row before."""
    wraps = lambda r: (F.get(r, F.lit(0)) == "") & F.exists(r, lambda c: c != "")
    joined = lambda a, b: F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.trim(F.concat_ws(" ", F.nullif(p["a"], F.lit("")), F.nullif(p["b"], F.lit("")))))

    def add(acc: Column, row: Column) -> Column:
        n = F.size(acc)
        return F.when((n > 0) & wraps(row), F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(joined(F.get(acc, n - 1), row)))).otherwise(F.concat(acc, F.array(row)))

    return bind(grid, lambda g: F.aggregate(g, F.slice(g, 1, 0), add))


def render(grid: Column) -> Column:
    """Body rows as `header: cell; ...` lines by the first row's names; nameless columns are `(col N)`."""

    def run(grid: Column) -> Column:
        header, body = F.get(grid, F.lit(0)), F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))
        name = lambda i: F.coalesce(F.nullif(F.get(header, i), F.lit("")), F.concat(F.lit("(col "), (i + 1).cast("string"), F.lit(")")))
        line = lambda r: F.array_join(F.filter(F.transform(r, lambda c, i: F.when(c != "", F.concat(name(i), F.lit(": "), c))), lambda x: x.isNotNull()), "; ")
        return F.transform(body, line)

    return bind(grid, run)


def richness(grid: Column) -> Column:
    """What makes one reading of a table better than another: columns, then filled cells."""
    return F.struct(F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0)).alias("columns"), F.aggregate(grid, F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda c: c != ""))).alias("filled"))


def expand_merged(cells: Column, rows: Column, columns: Column) -> Column:
    """A grid from cells (struct r0, r1, c0, c1, text; ends exclusive): each covers its whole area, the first wins."""
    at = lambda r, c: F.get(F.filter(cells, lambda x: (x["r0"] <= r) & (r < x["r1"]) & (x["c0"] <= c) & (c < x["c1"])), F.lit(0))["text"]
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), columns - 1), lambda c: F.coalesce(at(r, c), F.lit(""))))


def merge_header(grid: Column) -> Column:
    """A header of two rows as one: where the second row has a blank first cell and no number, its cells are added to those above."""

    def run(g: Column) -> Column:
        second = F.get(g, F.lit(1))
        below = (F.get(second, F.lit(0)) == "") & F.exists(second, lambda c: c != "") & ~F.exists(second, lambda c: c.rlike("[0-9]"))
        both = F.transform(F.get(g, F.lit(0)), lambda c, i: F.trim(F.concat_ws(" ", F.nullif(c, F.lit("")), F.nullif(F.get(second, i), F.lit("")))))
        return F.when((F.size(g) > 2) & below, F.concat(F.array(both), F.slice(g, 3, F.greatest(F.size(g) - 2, F.lit(0))))).otherwise(g)

    return bind(grid, run)


def merge_split_columns(grid: Column) -> Column:
    """A column without a name, none of whose cells stands beside a filled cell on its left, is the left column's other half."""

    def run(g: Column) -> Column:
        header = F.get(g, F.lit(0))
        half = lambda i: (i > 0) & (F.get(header, i) == "") & F.forall(g, lambda r: (F.get(r, i) == "") | (F.get(r, i - 1) == ""))
        places = F.sequence(F.lit(0), F.greatest(F.size(header) - 1, F.lit(0)))
        halves = F.transform(places, half)
        cell = lambda r, i: F.when(F.get(halves, i + 1), F.concat(F.get(r, i), F.get(r, i + 1))).otherwise(F.get(r, i))
        return bind(F.filter(places, lambda i: ~F.get(halves, i)), lambda kept: F.transform(g, lambda r: F.transform(kept, lambda i: F.coalesce(cell(r, i), F.lit("")))))

    return bind(grid, run)


def orientation(grid: Column) -> Column:
    """`transposed` where a long title fills the header, or the first column numbers attributes or holds text; else `rows`."""

    def run(g: Column) -> Column:
        header = F.filter(F.get(g, F.lit(0)), lambda c: F.trim(c) != "")
        same = F.array_max(F.transform(header, lambda c: F.when(F.length(c) > 30, F.size(F.filter(header, lambda x: x == c))).otherwise(0)))
        first = F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda r: F.trim(F.coalesce(F.get(r, F.lit(0)), F.lit(""))))
        n = F.size(first)
        numbered = F.size(F.filter(first, lambda c: c.rlike(r"^[0-9]+[.)]?\s+[A-Za-z]")))
        wordy = F.size(F.filter(first, lambda c: (c != "") & F.regexp_replace(c, "[,%()]", "").try_cast("double").isNull()))
        small = (F.size(g) < 3) | (F.size(F.get(g, F.lit(0))) < 3)
        return F.when(small, "rows").when((F.size(header) >= 3) & (same >= F.greatest(F.lit(3.0), 0.6 * F.size(header))), "transposed").when((numbered >= F.greatest(F.lit(3.0), 0.5 * n)) | (wordy >= F.greatest(F.lit(3.0), 0.7 * n)), "transposed").otherwise("rows")

    return bind(grid, run)


def is_answer(roles: Column, rows: Column, cells: Column, prose: Column) -> Column:
    """Whether a table is the answer: a column of entities, two rows or more, and three tenths as many characters as the prose beside it."""
    return F.exists(roles, lambda r: r.isin("project_name", "location", "status")) & (rows >= 2) & (cells >= 0.3 * F.greatest(F.lit(1), prose))
