"""Table access: the raw tables with declared schemas, entity tables with
tenant pruning, and the derived views both engines can compute."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.packed import PACKED, PART, pack_rows, unpack_rows
from ledgerloom.session import shuffle_partitions
from ledgerloom.sources import schemas
from ledgerloom.sources.fixtures import VIEWS

_NAME = re.compile(r"\b[a-z_]+\b")


def referenced(sql: str, names) -> list[str]:
    """Table names from ``names`` that a statement mentions, in first-use order."""
    names = set(names)
    return list(dict.fromkeys(word for word in _NAME.findall(sql) if word in names))


def view_closure(sql: str) -> list[str]:
    """Derived views a statement needs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in referenced(text, VIEWS):
            if name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    return ordered


class Tables:
    """Tables of one data directory as attributes: ``Tables(spark, d).orders``,
    ``.v_sales``. Every read is lazy, so column pruning and filter pushdown
    reach the Parquet scan through the view definitions."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.RAW[name]).parquet(f"{self.directory}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in schemas.RAW and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self.raw(name) if name in schemas.RAW else self._derive(name)
        return self._known[name]

    def _derive(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        for source in referenced(sql, list(VIEWS) + list(schemas.RAW)):
            if source != name and re.search(rf"\b(FROM|JOIN) {source}\b", sql):
                # A temp view is resolved when the statement is analysed, so a
                # later Tables over another directory cannot change this plan.
                getattr(self, source).createOrReplaceTempView(f"ledgerloom_{source}")
                sql = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 ledgerloom_{source}", sql)
        return self.spark.sql(sql)


def read_entity(spark: SparkSession, root: str, entity: str, company_id: str | None = None) -> DataFrame:
    """One ledger entity from ``root/entity`` (Parquet, partitioned by
    company). A given company prunes to its partition before any file is read."""
    df = spark.read.schema(schemas.ENTITIES[entity]).parquet(f"{root.rstrip('/')}/{entity}")
    return df if company_id is None else for_company(df, company_id)


def as_entity(df: DataFrame, entity: str) -> DataFrame:
    """Rows with the entity's declared columns; those ``df`` lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in T._parse_datatype_string(schemas.ENTITIES[entity]).fields])


def write_entity(df: DataFrame, root: str, entity: str, mode: str = "append", declared: bool = True) -> None:
    """Rows of the same company may be a third of the table, so files are split
    by size (AQE's rebalance) and not gathered into one task per company. Without
    ``declared`` columns they get those after they are dealt: what is null in every
    row does not travel."""
    rows = dealt_by_company(df)
    ((rows if declared else as_entity(rows, entity)).write.mode(mode).option("compression", "zstd").partitionBy("company_id")
     .parquet(f"{root.rstrip('/')}/{entity}"))


def dealt_by_company(df: DataFrame) -> DataFrame:
    """The rows gathered by company, as packed columns on their way."""
    part = F.pmod(F.hash("company_id"), F.lit(shuffle_partitions(df.sparkSession))).cast("long")
    packed = df.withColumn(PART, part).mapInArrow(pack_rows, PACKED).hint("rebalance", PART)
    return packed.mapInArrow(unpack_rows(to_arrow_schema(df.schema)), df.schema)


def for_company(df: DataFrame, company_id) -> DataFrame:
    return df.where(F.col("company_id") == F.lit(company_id))


def within(column: str, allowed: tuple[str, ...]) -> Column:
    """Closed vocabularies are stored as text; this is the check at the edge."""
    return F.col(column).isin(*allowed)
