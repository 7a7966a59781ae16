"""Small tables given as rows, for Spark and as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _type(name: str) -> str:
    return f"{_SQL[name[6:-1]]}[]" if name.startswith("array<") else _SQL[name]


def _value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(_value, x)) + "]"
    return repr(x)


@dataclass
class Literal:
    name: str
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def cte(self) -> str:
        """name AS (...), to stand after WITH."""
        columns = [c.split(" ") for c in self.schema.split(", ")]
        cast = ", ".join(f'"{c}"::{_type(k)} AS "{c}"' for c, k in columns)
        rows = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {cast} FROM (VALUES {rows}) v({', '.join(chr(34) + c + chr(34) for c, _ in columns)}))"


def ctes(*tables: Literal) -> str:
    return ", ".join(x.cte for x in tables)
