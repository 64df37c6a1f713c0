"""The read-only SQL console over registered views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lumenset.sources.views import TABLES, VIEWS, Views

#: The statements that the console accepts, by first keyword.
ALLOWED = ("select", "explain", "with", "describe", "show")


#: What a parsed statement may be besides a query, by the names of its plan's classes.
READING = ("Describe", "Show", "Explain")
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"


class Refused(ValueError):
    """The statement doesn't start with an allowed keyword, or it writes."""


def _nodes(plan):
    """All nodes of a parsed plan; what is explained counts too."""
    yield plan
    if plan.getClass().getSimpleName().startswith("Explain"):
        yield from _nodes(plan.logicalPlan())
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _writes(spark: SparkSession, sql: str) -> str | None:
    """The first node of the parsed statement that is a command other than a reading one, or an insert."""
    of = spark._jvm.org.apache.spark.util.Utils.classForName
    kinds = [of(f"{LOGICAL}.{k}", True, False) for k in ("Command", "ParsedStatement")]
    for node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        name = node.getClass().getSimpleName()
        if any(k.isInstance(node) for k in kinds) and not name.startswith(READING):
            return name
    return None


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """Runs one reading statement; comments before its first keyword don't count.

    The statement is parsed before it runs, and refused if any part of it is an insert or another command, such as the
    body of ``WITH ... INSERT``.
    """
    bare = re.sub(r"^(\s|--[^\n]*\n|/\*.*?\*/|\()+", "", sql, flags=re.S)
    word = re.match(r"[A-Za-z]*", bare)[0].lower()
    if word not in ALLOWED:
        raise Refused(f"only {', '.join(ALLOWED)} statements run here")
    if found := _writes(spark, sql):
        raise Refused(f"{found} writes; only reading statements run here")
    return spark.sql(sql)


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables and media views."""
    views = Views(spark, sf_dir)
    for name in names or [*TABLES, *VIEWS]:
        views(name).createOrReplaceTempView(name)
