"""Registry of runnable queries: a Spark plan per key and, where SQL can say the
same thing, the statement the checking engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.fixtures import VIEWS
from ledgerloom.sources.tables import Tables, view_closure

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if key in PLANS:
            raise ValueError(f"{key} is registered twice")
        PLANS[key] = plan
        if sql is not None:
            views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in view_closure(sql))
            ORACLES[key] = f"WITH {views}\n{sql}" if views else sql
        return plan

    return register


def printable(df: DataFrame) -> DataFrame:
    """Dates, times and lists as text, the one form both engines print alike."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.concat_ws("|", column)
        out.append(column.alias(field.name))
    return df.select(*out)


def runnable(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, directory: printable(plan(Tables(spark, directory)))


# Pieces of checking SQL that many statements share.


def cents(expression: str, condition: str | None = None) -> str:
    value = f"CAST(round(({expression}) * 100, 0) AS BIGINT)"
    if condition:
        value = f"CASE WHEN {condition} THEN {value} END"
    return f"(CAST(COALESCE(SUM({value}), 0) AS DOUBLE) / 100)"


def seconds(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def label(expression: str) -> str:
    return f"concat('PKR ', format('{{:,}}', CAST(round_even({expression}, 0) AS BIGINT)))"


def count_if(condition: str) -> str:
    return f"COUNT(CASE WHEN {condition} THEN 1 END)"


CASHBOOK = "type = 'purchase' AND status IN ('validated', 'sent_to_accounting') AND transaction_status = 'transactional'"
SCANNED = "type = 'sale' AND extraction_source IS NOT NULL AND extraction_source <> 'generated'"
BUCKET = "COALESCE(invoice_date, CAST(created_at AS DATE))"
