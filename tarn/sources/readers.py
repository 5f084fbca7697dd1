"""Readers: one function per source kind, from a resource name to a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tarn.errors import SourceError

Reader = Callable[[SparkSession, str, object], DataFrame]


def _files(kind: str, **options: str) -> Reader:
    def read(spark: SparkSession, resource: str, address: object) -> DataFrame:
        return spark.read.format(kind).options(**options).load(f"{str(address).rstrip('/')}/{resource}")

    return read


def _table(spark: SparkSession, resource: str, address: object) -> DataFrame:
    return spark.table(f"{address}.{resource}" if address else resource)


def _database(**defaults: str) -> Reader:
    """Filters and columns are pushed to the database by Spark's reader; the address gives the url or all options."""

    def read(spark: SparkSession, resource: str, address: object) -> DataFrame:
        given = dict(address) if isinstance(address, Mapping) else {"url": str(address)}
        return spark.read.format("jdbc").options(**defaults | given | {"dbtable": resource}).load()

    return read


#: Each connection of a reader says this first: nothing is written, and moments are read as UTC.
POSTGRES_SESSION = "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY; SET TIME ZONE 'UTC'"

# How SQLSTATEs, or classes of them, are told to callers.
STATES = {
    "28": "source_authentication_failed",
    "08004": "source_authentication_failed",
    "42501": "source_permission_denied",
    "42502": "source_permission_denied",
    "08": "source_unavailable",
    "53": "source_unavailable",
    "57": "source_unavailable",
    "3D": "source_unavailable",
    "XJ": "source_unavailable",
}


def database_error(error: BaseException) -> str | None:
    """The code for a failure that a database's driver reported; None if it reported no such state."""
    thrown = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    for _ in range(16):
        if thrown is None:
            return None
        try:
            state = thrown.getSQLState() or ""
        except (Py4JError, TypeError):
            state = ""
        for start in (state, state[:2]):
            if start in STATES:
                return STATES[start]
        thrown = thrown.getCause()
    return None


READERS: dict[str, Reader] = {
    "parquet": _files("parquet"),
    "orc": _files("orc"),
    "csv": _files("csv", header="true", inferSchema="true"),
    "json": _files("json"),
    "table": _table,
    "jdbc": _database(pushDownPredicate="true", pushDownLimit="true"),
    "postgres": _database(
        driver="org.postgresql.Driver", sessionInitStatement=POSTGRES_SESSION, pushDownPredicate="true", pushDownLimit="true"
    ),
}


def register_reader(kind: str, reader: Reader) -> None:
    """Add or replace the reader of a source kind."""
    READERS[kind] = reader


def open_resource(spark: SparkSession, kind: str, resource: str, address: object) -> DataFrame:
    if kind not in READERS:
        raise SourceError("source_kind_unsupported", f"There is no reader for sources of kind '{kind}'.")
    try:
        return READERS[kind](spark, resource, address)
    except (PySparkException, Py4JJavaError) as error:
        if (code := database_error(error)) is not None:
            raise SourceError(code, "The source cannot be read.", retryable=code == "source_unavailable") from error
        raise
