"""A catalog's constraints over its tables as they are: nulls, row checks, keys, uniques and references, counted in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolworks.sources.schemas import CATALOG, Table

KINDS = ("not_null", "check", "unique", "reference")


def _counted(name: str, df: DataFrame, spec: Table) -> DataFrame:
    """Rows with a null where none may be, and rows that fail a check (null passes): one pass over the table."""
    rules: list[tuple[str, str, Column]] = [("not_null", f.name, F.col(f.name).isNull()) for f in spec.schema.fields if not f.nullable]
    rules += [("check", rule, ~F.coalesce(F.expr(condition), F.lit(True))) for rule, condition in spec.checks.items()]
    one = df.agg(*[F.count_if(bad).alias(f"__{i}") for i, (_, _, bad) in enumerate(rules)])
    told = [F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.col(f"__{i}").alias("rows")) for i, (kind, rule, _) in enumerate(rules)]
    return one.select(F.lit(name).alias("table_name"), F.inline(F.array(*told)))


def _repeated(name: str, df: DataFrame, columns: tuple[str, ...], where: str | None) -> DataFrame:
    """Rows beyond the first of each combination without nulls, among those `where` is about."""
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    held = df.where(there & F.expr(where)) if where else df.where(there)
    groups = held.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit("unique").alias("kind"), F.lit(", ".join(columns)).alias("rule"), "rows")


def _orphans(name: str, df: DataFrame, column: str, parent: DataFrame, parent_name: str, parent_key: str) -> DataFrame:
    """Rows whose value no row of the parent has; nulls refer to nothing. Values are counted before they meet the parent's, so a value
    of very many rows is one row of the join."""
    asked = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("n"))
    lost = asked.join(parent.select(F.col(parent_key).alias("__v")).where("__v IS NOT NULL").distinct(), "__v", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit("reference").alias("kind"), F.lit(f"{column} -> {parent_name}.{parent_key}").alias("rule"), "rows")


def broken_constraints(tables: dict[str, DataFrame], catalog: dict[str, Table] = CATALOG) -> DataFrame:
    """(table_name, kind, rule, rows) of every constraint of `catalog` on the tables given, zeros included.

    `kind` is one of KINDS; primary keys are uniques. Uniques count the rows beyond the first, the others the rows at fault. A table
    may lack columns that are nullable and in no rule; more columns are left alone. References to tables that are not given
    are left out.
    """
    found = []
    for name, df in tables.items():
        spec = catalog[name]
        found.append(_counted(name, df, spec))
        found += [_repeated(name, df, columns, where) for columns, where in uniques(spec)]
        found += [_orphans(name, df, column, tables[parent], parent, key) for column, (parent, key, _) in spec.references.items() if parent in tables]
    return reduce(DataFrame.unionByName, found).withColumn("rows", F.col("rows").cast("long"))


def uniques(spec: Table) -> list[tuple[tuple[str, ...], str | None]]:
    """(columns, condition) of the primary key and the uniques of a table."""
    found: list[tuple[tuple[str, ...], str | None]] = [(spec.key, None)]
    if spec.unique:
        found.append((spec.unique, None))
    if spec.unique_where:
        found.append(spec.unique_where)
    return found


def catalog_columns(catalog: dict[str, Table] = CATALOG) -> list[tuple[str, str, str, bool]]:
    """(table, column, type, nullable) of a catalog."""
    return [(name, f.name, f.dataType.simpleString(), f.nullable) for name, spec in catalog.items() for f in spec.schema.fields]
