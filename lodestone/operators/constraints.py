"""Declared constraints, reported as frames of violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """Row rule: ``holds`` must not be false (unknown passes, as in SQL)."""

    name: str
    holds: Column


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Foreign key: non-null ``columns`` must exist in ``parent``'s columns."""

    name: str
    columns: tuple[str, ...]
    parent: DataFrame
    parent_columns: tuple[str, ...]


def violations(table: DataFrame, rules: list[Check | Unique | Reference]) -> DataFrame:
    """``(rule, n)`` with every rule that is broken.

    All row rules are counted in one scan. A uniqueness rule counts surplus rows
    after a map-side combined count; a reference rule is one anti join.
    """
    spark = table.sparkSession
    checks = [r for r in rules if isinstance(r, Check)]
    out = spark.createDataFrame([], "rule string, n long")
    if checks:
        counted = table.agg(*[F.count_if(~r.holds).alias(f"c{i}") for i, r in enumerate(checks)])
        named = F.array(*[
            F.struct(F.lit(r.name).alias("rule"), F.col(f"c{i}").alias("n"))
            for i, r in enumerate(checks)
        ])
        out = out.unionByName(counted.select(F.explode(named).alias("v")).select("v.rule", "v.n"))
    for rule in rules:
        if isinstance(rule, Unique):
            surplus = table.groupBy(*rule.columns).count().filter("count > 1")
            found = surplus.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
        elif isinstance(rule, Reference):
            parent = rule.parent.select(
                *[F.col(c).alias(f"_p{i}") for i, c in enumerate(rule.parent_columns)]
            )
            child = table.select(*rule.columns).dropna()
            same = F.lit(True)
            for i, c in enumerate(rule.columns):
                same = same & (F.col(c) == F.col(f"_p{i}"))
            found = child.join(parent, same, "left_anti").agg(F.count(F.lit(1)).alias("n"))
        else:
            continue
        out = out.unionByName(found.select(F.lit(rule.name).alias("rule"), "n"))
    return out.filter("n > 0")


def migration_checksum(sql: Column) -> Column:
    """Digest of a migration; trailing blanks of a line do not count, anything else does."""
    lines = F.split(F.regexp_replace(sql, r"(?U)^\s+|\s+$", ""), "\r\n|\n|\r")
    return F.sha2(
        F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"), 256
    )


#: Four digits, and more of them after version 9999; a version has one name.
MIGRATION_VERSION = r"^(\d{4}|[1-9]\d{4,17})_"


def _version(pattern: str) -> Column:
    """The number of a migration file; null when its name does not match."""
    return F.nullif(F.regexp_extract("file", pattern, 1), F.lit("")).cast("long")


def migration_problems(files: DataFrame, applied: DataFrame) -> DataFrame:
    """``(file, problem)`` from ``files(file, sql)`` and ``applied(version, checksum)``."""
    named = files.select(
        "file", "sql", _version(MIGRATION_VERSION + r"[a-z0-9_]+\.sql$").alias("version")
    )
    bad_name = named.filter("version IS NULL").select("file", F.lit("bad file name").alias("problem"))
    good = named.filter("version IS NOT NULL").withColumn(
        "checksum", migration_checksum(F.col("sql"))
    )
    empty = good.filter(F.trim("sql") == "").select("file", F.lit("empty").alias("problem"))
    twice = good.groupBy("version").agg(F.max("file").alias("file"), F.count(F.lit(1)).alias("c"))
    duplicate = twice.filter("c > 1").select("file", F.lit("duplicate version").alias("problem"))
    # Versions are contiguous from 1 exactly when every version but 1 has a predecessor.
    before = good.select((F.col("version") + 1).alias("version"))
    gap = good.filter("version <> 1").join(before, "version", "left_anti").select(
        "file", F.lit("gap before this version").alias("problem")
    )
    both = applied.withColumnRenamed("checksum", "recorded").join(good, "version", "left")
    gone = both.filter("file IS NULL").select(
        F.format_string("%04d", "version").alias("file"), F.lit("applied but missing").alias("problem")
    )
    edited = both.filter("checksum <> recorded").select(
        "file", F.lit("edited after it was applied").alias("problem")
    )
    parts = [bad_name, empty, duplicate, gap, gone, edited]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pending_migrations(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Files whose version is not applied; a name without a version is a problem, not pending."""
    numbered = files.withColumn("version", _version(MIGRATION_VERSION)).filter("version IS NOT NULL")
    return numbered.join(applied, "version", "left_anti").select(
        "version", "file", migration_checksum(F.col("sql")).alias("checksum")
    )
