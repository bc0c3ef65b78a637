"""Steps that may fail row by row: a bad row becomes an error row, and the run goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row


def attempted(rows: DataFrame, make: Callable[[], Callable[[Row], dict]], result: str) -> DataFrame:
    """rows with ok, error and result (a struct of these fields): what the function that make() gives returns for each row.

    make() is called once in each worker, for what takes long to load; if that fails, all rows of the worker have its error. An exception is the
    row's error, with its kind. A result of None is an error as well.
    """
    made: list = []

    @F.udf(returnType=f"struct<ok: boolean, error: string, result: struct<{result}>>", useArrow=True)
    def attempt(row: Row) -> tuple:
        try:
            if not made:
                made.append(make())
            found = made[0](row)
        except Exception as e:
            return False, f"{type(e).__name__}: {e}", None
        return (True, None, found) if found is not None else (False, "no result", None)

    both = rows.withColumn("_attempt", attempt(F.struct(*rows.columns)))
    return both.select(*rows.columns, "_attempt.ok", "_attempt.error", "_attempt.result")


def checked(rows: DataFrame, error: Column, result: Column) -> DataFrame:
    """rows with ok, error and result of an expression: the result where there is no error."""
    return rows.select(*rows.columns, error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), result).alias("result"))


def routed(attempts: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows with the result's fields, and bad rows with their error. The attempts run once: one write deals them to a folder each."""
    spark = attempts.sparkSession
    attempts.write.mode("overwrite").partitionBy("ok").parquet(path)
    found = spark.read.schema(attempts.schema).parquet(path)
    own = [c for c in attempts.columns if c not in ("ok", "error", "result")]
    return found.where("ok").select(*own, "result.*"), found.where("NOT ok").select(*own, "error")
