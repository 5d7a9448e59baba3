"""Guarded read-only SQL and parameterised queries over temp views."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F


class RefusedSql(ValueError):
    """The statement is not a plain read of the allowed relations."""


#: Leaves of a query's own making; every other leaf must lie below an allowed view.
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}


def _items(seq) -> list:
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _functions(expression) -> list[str]:
    """Class names of an expression and all its parts."""
    out, todo = [], [expression]
    while todo:
        e = todo.pop()
        out.append(e.getClass().getSimpleName())
        todo += _items(e.children())
    return out


def _relations_read(plan, allowed: set[str]) -> set[str]:
    """Views that an analysed plan reads; refuses whatever is not a plain read of the allowed ones."""
    read, todo = set(), [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if "Command" in name or "Python" in name or "Pandas" in name or "Arrow" in name:
            raise RefusedSql(f"only SELECT is allowed, found {name}")
        if name == "View":
            view = node.desc().identifier().table().lower()
            if view not in allowed or not node.isTempView():
                raise RefusedSql(f"relation not allowed: {view}")
            read.add(view)
            continue  # what the view itself reads is the caller's business
        for function in (f for e in _items(node.expressions()) for f in _functions(e)):
            if "Reflect" in function or "Python" in function or function in ("ScalaUDF", "StaticInvoke", "Invoke"):
                raise RefusedSql(f"function not allowed: {function}")
        children = _items(node.children())
        if not children and name not in _OWN_LEAVES:
            raise RefusedSql(f"relation not allowed: {name}")
        todo += [*children, *_items(node.innerChildren()), *_items(node.subqueries())]
    return read


def execute_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], required: str | None = None) -> DataFrame:
    """Run a SELECT over the given views only.

    The statement is put in brackets, where the grammar takes nothing but a query, and its analysed plan is inspected:
    names are resolved then, so a CTE hides a table only where it is in scope, and a computed name or a file path shows
    what it reads. `required` must be among the relations read. Session views of the same names come back afterwards.
    """
    catalog = spark.catalog
    before = {name: spark.table(name) for name in views if catalog.tableExists(name)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        try:
            out = spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
        except Exception as error:  # the parser's and the analyser's own exception types
            raise RefusedSql(f"not a query: {str(error).splitlines()[0]}") from None
        read = _relations_read(out._jdf.queryExecution().analyzed(), {v.lower() for v in views})
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                catalog.dropTempView(name)
    if not read:
        raise RefusedSql("the query reads no table")
    if required and required.lower() not in read:
        raise RefusedSql(f"the query must read {required}")
    return out


# declared type: how its text becomes a value
CONVERT = {
    "STRING": str, "INT64": int, "BIGINT": int, "INT": int, "FLOAT64": float, "DOUBLE": float, "NUMERIC": Decimal,
    "BOOL": lambda v: v.lower() == "true", "BOOLEAN": lambda v: v.lower() == "true", "DATE": date.fromisoformat,
    "TIMESTAMP": lambda v: datetime.fromisoformat(v).replace(tzinfo=timezone.utc), "BYTES": lambda v: bytearray(v, "utf-8"),
}


def parse_parameter(text: str) -> tuple[str, object]:
    """`name:type:value` to (name, value); no type means STRING, the value NULL is null, arrays are JSON."""
    parts = text.split(":", 2)
    if len(parts) != 3:
        raise ValueError("parameters look like name:type:value, :type:value or name::value")
    name, kind, value = parts
    kind = kind.upper() or "STRING"
    if value == "NULL":
        return name, None
    if kind.startswith("ARRAY<"):
        convert = CONVERT[kind[6:-1]]
        return name, F.array(*[F.lit(convert(str(v))) for v in json.loads(value)])
    if kind not in CONVERT:
        raise ValueError(f"parameter type {kind} is not supported")
    return name, CONVERT[kind](value)


def query(spark: SparkSession, sql: str, params: Sequence[str] = (), views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL with `:name` or `?` markers bound to parsed parameters."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    parsed = [parse_parameter(p) for p in params]
    named = [p for p in parsed if p[0]]
    if named and len(named) != len(parsed):
        raise ValueError("either all parameters have a name or none has")
    if not params:
        return spark.sql(sql)
    return spark.sql(sql, args=dict(parsed) if named else [v for _, v in parsed])
