"""Where the named queries and their SQL equivalents are kept.

Sums of doubles depend on their order in the last digits; results are rounded for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources.samples import EVENTS_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, samples: str | None = EVENTS_SQL):
    """Register a function (spark, folder) -> DataFrame; ``sql`` follows the ``WITH`` of ``samples``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.lstrip(", ")
            SQL[f.__name__] = f"WITH {samples}{' ' if body.startswith('SELECT') else ', '}{body}" if samples else body
        return f

    return add


#: Tables of each sample's elevation offset, ``ap`` (tod, det, samp, dat, a); azimuth stands for elevation.
OFFSETS_SQL = """mn AS (SELECT tod, samp, avg(az) AS y FROM samples GROUP BY tod, samp), nn AS (SELECT tod, max(samp) + 1 AS n FROM mn GROUP BY tod), qq AS (SELECT tod, n, samp / n::DOUBLE - 0.5 AS x, y FROM mn JOIN nn USING (tod)),
 ss AS (SELECT tod, n, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS y0, sum(y * x) AS y1, sum(y * x * x) AS y2 FROM qq GROUP BY tod, n),
 dd AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS d FROM ss),
 cc AS (SELECT tod, n, (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / d AS c0, (s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / d AS c1, (s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / d AS c2 FROM dd),
 oo AS (SELECT tod, det, samp, dat, az - (c0 + c1 * (samp / n::DOUBLE - 0.5) + c2 * pow(samp / n::DOUBLE - 0.5, 2)) AS o FROM samples JOIN cc USING (tod)), ap AS (SELECT tod, det, samp, dat, o / max(abs(o)) OVER (PARTITION BY tod) AS a FROM oo)"""


def named(name: str, f):
    f.__name__ = name
    return f


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"
