"""Read-only SQL over the canonical tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 500
#: Plans that only read have none of these at their root.
_COMMANDS = ("Command", "Insert", "CreateTable", "Drop", "Delete", "Update", "Merge", "Truncate", "Alter", "SetCatalog", "SetNamespace", "CacheTable", "Unresolved3PartName")


class NotReadOnly(ValueError):
    """The text isn't a single query."""


def strip_fences(text: str) -> str:
    """The SQL inside a fenced block, without a closing semicolon."""
    found = re.search(r"```(?:sql)?\s*(.*?)```", text, re.S | re.I)
    return (found[1] if found else text).strip().rstrip(";").strip()


#: Functions that reach beyond the data.
_FORBIDDEN = ("java_method", "reflect", "try_reflect")
#: Table functions that make rows from their arguments alone.
_GENERATORS = ("range", "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack")


def parsed_plan(spark: SparkSession, text: str):
    """Spark's own parse of one statement; two statements are a syntax error to it."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


class _Guard:
    """Walks a parsed plan with the names that each place of it can see: the given views, and common tables where SQL's scopes have them."""

    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway

    def _is(self, x, kind: str) -> bool:
        return is_instance_of(self.gateway, x, kind)

    def _items(self, x) -> Iterator:
        it = x.iterator() if self._is(x, "scala.collection.Iterable") else x.productIterator()
        while it.hasNext():
            yield it.next()

    def walk(self, x, names: frozenset[str]) -> None:
        """x: a node, an expression, or what they consist of. NotReadOnly at the first thing that isn't allowed."""
        if not isinstance(x, JavaObject) or not (self._is(x, "scala.Product") or self._is(x, "scala.collection.Iterable")):
            return
        kind = x.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            inside = names
            for pair in self._items(x.cteRelations()):
                own = pair._1().lower()
                # A table sees those before it, and itself only where recursion is asked for.
                self.walk(pair._2(), inside | {own} if x.allowRecursion() else inside)
                inside = inside | {own}
            return self.walk(x.child(), inside)
        if kind == "UnresolvedRelation":
            parts = list(self._items(x.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in names:
                raise NotReadOnly(f"no such view: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            if (name := ".".join(self._items(x.name())).lower()) not in _GENERATORS:
                raise NotReadOnly(f"not allowed: {name}")
        elif kind == "UnresolvedFunction":
            if (name := list(self._items(x.nameParts()))[-1].lower()) in _FORBIDDEN:
                raise NotReadOnly(f"not allowed: {name}")
        elif kind == "ScriptTransformation":
            raise NotReadOnly("programs aren't run")
        elif "UnresolvedIdentifier" in kind:
            raise NotReadOnly("names must be written out")
        for part in self._items(x):
            self.walk(part, names)


def read_only(spark: SparkSession, text: str, views: Iterable[str] = ()) -> str:
    """The statement, if Spark parses it as one query over the given views. What literals say doesn't matter, as the plan's nodes decide.

    Refused: commands, other tables, files by path, names that are computed, functions that call methods of the JVM, and programs.
    """
    sql = strip_fences(text)
    if not re.match(r"(?i)\s*\(*\s*(select|with)\b", sql):
        raise NotReadOnly("only SELECT and WITH queries are run")
    try:
        plan = parsed_plan(spark, sql)
    except Exception as e:
        raise NotReadOnly(str(e).splitlines()[0]) from e
    root = plan.getClass().getSimpleName()
    if any(c in root for c in _COMMANDS):
        raise NotReadOnly(f"not a query: {root}")
    _Guard(spark).walk(plan, frozenset(v.lower() for v in views))
    return sql


def run(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, most: int = MAX_ROWS) -> DataFrame:
    """The query's first rows, `most` at most, over the given views (events, batches)."""
    sql = read_only(spark, text, views or ())
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql).limit(most)
