"""Reports from logs of iterations.

A line reads `time LEVEL TIC|TOC - marker - message`, the time as HH:mm:ss,SSS.
parse() works on a table of lines and on a stream of them.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})\s+\S+\s+(TIC|TOC) - (\S+) - (.*)$"


def parse(lines: DataFrame) -> DataFrame:
    """(ms, mark, marker, message) of the lines that match; ms since midnight."""
    part = lambda k: F.regexp_extract("value", LINE, k)
    ms = ((part(1).cast("bigint") * 60 + part(2).cast("bigint")) * 60 + part(3).cast("bigint")) * 1000 + part(4).cast("bigint")
    return lines.where(F.col("value").rlike(LINE)).select(ms.alias("ms"), part(5).alias("mark"), part(6).alias("marker"), part(7).alias("message"))


def report(parsed: DataFrame) -> DataFrame:
    """(marker, duration_ms): from the first TIC to the last TOC; an end before its start is on the next day."""
    sums = parsed.groupBy("marker").agg(F.min(F.when(F.col("mark") == "TIC", F.col("ms"))).alias("tic"), F.max(F.when(F.col("mark") == "TOC", F.col("ms"))).alias("toc"))
    day = 24 * 3600 * 1000
    return sums.where("tic is not null and toc is not null").select("marker", (F.col("toc") - F.col("tic") + F.when(F.col("toc") < F.col("tic"), day).otherwise(0)).alias("duration_ms"))


class TicToc:
    """Lines of such a log, from a driver loop."""

    def __init__(self):
        self.lines: list[str] = []

    def _note(self, mark: str, marker: str, message: str) -> None:
        now = time.time()
        self.lines.append(f"{time.strftime('%H:%M:%S', time.gmtime(now))},{int(now * 1000) % 1000:03d} INFO {mark} - {marker} - {message}")

    def tic(self, marker: str, message: str = "") -> None:
        self._note("TIC", marker, message)

    def toc(self, marker: str, message: str = "") -> None:
        self._note("TOC", marker, message)


def kernel_times(df: DataFrame, name: str):
    """(df, observation): rows are counted as they pass, without another job."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
