"""Only aggregates may be shared: a walk over the analysed plan of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Aggregate functions that hand single rows on, by the name of their class.
CARRIES = ("CollectList", "CollectSet", "CollectTopK", "First", "Last", "AnyValue", "MaxBy", "MinBy", "MaxMinByK",
           "ListAgg", "HistogramNumeric", "Mode", "Max", "Min")


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _functions(expression) -> list[str]:
    """Class names of an expression and all below it."""
    out = [expression.getClass().getSimpleName()]
    for child in _items(expression.children()):
        out += _functions(child)
    return out


def row_paths(df: DataFrame, *, extremes: bool = True) -> list[str]:
    """Why rows of a table can reach the output; empty if every path passes an aggregate.

    Every way from a scan, a file or given rows up to the output must pass a grouping or global
    aggregate whose functions do not hand on single values; this holds for both sides of
    joins and unions and for subqueries in expressions. DISTINCT passes rows on. ``extremes`` lets
    minimum and maximum pass. Windows, filters and sorts change nothing.
    """
    carries = [c for c in CARRIES if not (extremes and c in ("Max", "Min"))]
    faults: list[str] = []

    def safe(node) -> bool:
        """Whether no path from a leaf to here is free of aggregates."""
        name = node.nodeName()
        for inner in _items(node.subqueries()):
            if not safe(inner):
                faults.append(f"subquery of {name}")
        if name == "Aggregate":
            given = [f for e in _items(node.aggregateExpressions()) for f in _functions(e)]
            found = [f for f in carries if f in given]
            if found:
                faults.append(f"aggregate that hands on rows: {found[0]}")
            functions = [f for f in given if f == "AggregateExpression"]
            if functions:
                _ = [safe(c) for c in _items(node.children()) if _items(c.subqueries())]
                return True
            # grouping without any function is DISTINCT
        children = _items(node.children())
        if not children:
            if name in ("OneRowRelation", "Range"):
                return True
            faults.append(f"{name} without an aggregate above it")
            return False
        return all([safe(c) for c in children])

    safe(df._jdf.queryExecution().analyzed())
    return list(dict.fromkeys(faults))


def require_aggregates(df: DataFrame, *, extremes: bool = True) -> DataFrame:
    """The frame itself, or an error that names the way on which rows would leave."""
    faults = row_paths(df, extremes=extremes)
    if faults:
        raise PermissionError("rows would leave the private root: " + "; ".join(faults))
    return df


def small_cells(df: DataFrame, count: str, least: int) -> DataFrame:
    """Rows of a result that stand for fewer than ``least`` subjects."""
    return df.where(df[count] < least)
