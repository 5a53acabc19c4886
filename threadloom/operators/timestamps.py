"""Problem 1: mixed timestamp forms and zones, through a persisted dictionary of distinct texts.

Every different (text, zone, locale) is parsed once.  The dictionary is an append-only Parquet
table; a batch of rows first subtracts what it already holds, parses the rest and appends it as
a new run.  Rows then get their instant by an equi-join on the three columns.

Defined results: null, blank and unreadable texts, unknown zones, impossible readings and
readings that a clock has twice or never give no dictionary entry with an instant (the entry is
kept with a null so that it is not parsed again) and hence a null ``utc_micros``; rows are never
lost or multiplied, whatever other columns they carry.  A text that a third of all rows share is
one dictionary row; the join back splits its rows by AQE's skew handling, and blank texts do not
take part in the join at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.instants import InstantParser
from threadloom.functions.identity import strip

DICTIONARY = T.StructType(
    [
        T.StructField("_raw", T.StringType()),
        T.StructField("_tz", T.StringType()),
        T.StructField("_locale", T.StringType()),
        T.StructField("_micros", T.LongType()),
    ]
)
_KEYS = ["_raw", "_tz", "_locale"]


class InstantDictionary:
    """Distinct date texts and their instants at ``path``.  ``zones``: zones whose abbreviations are known (at most the IANA list)."""

    def __init__(self, spark: SparkSession, path: str, zones: list[str]):
        self.spark, self.path, self.zones = spark, path, sorted(zones)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(DICTIONARY).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], DICTIONARY)

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def update(self, keyed: DataFrame) -> None:
        """Append what ``keyed`` (columns _raw, _tz, _locale) has beyond the table."""
        new = keyed.select(*_KEYS).where(F.col("_raw") != "").distinct()
        if self._exists():
            new = new.join(self.read().select(*_KEYS), _KEYS, "left_anti")
        zones = self.zones

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parser = InstantParser(zones)
            for b in batches:
                b["_micros"] = pd.array(
                    [parser.parse(r, t or None, o or None) for r, t, o in zip(b["_raw"], b["_tz"], b["_locale"])], dtype="Int64"
                )
                yield b

        new.mapInPandas(parse, DICTIONARY).write.mode("append").parquet(self.path)


def _keyed(df: DataFrame, raw: str, tz: str, locale: str) -> DataFrame:
    return df.withColumns(
        {
            "_raw": strip(F.coalesce(F.col(raw), F.lit(""))),
            "_tz": F.coalesce(F.col(tz), F.lit("")),
            "_locale": F.coalesce(F.col(locale), F.lit("")),
        }
    )


def normalise_instants(
    df: DataFrame, raw: str, tz: str, locale: str, dictionary: InstantDictionary, out: str = "utc_micros", keep_unread: bool = True
) -> DataFrame:
    """``df`` with the instant of column ``raw`` in ``out``; without ``keep_unread`` only rows that have one."""
    keyed = _keyed(df, raw, tz, locale)
    dictionary.update(keyed)
    known = dictionary.read().where(F.col("_micros").isNotNull()).withColumnRenamed("_micros", out)
    if not keep_unread:
        return keyed.where(F.col("_raw") != "").join(known, _KEYS).drop(*_KEYS)
    blank = F.col("_raw") == ""
    read = keyed.where(~blank).join(known, _KEYS, "left").drop(*_KEYS)
    return read.unionByName(keyed.where(blank).drop(*_KEYS).withColumn(out, F.lit(None).cast("bigint")))


def account_zones(accounts: DataFrame) -> list[str]:
    """Zone names of the accounts: distinct, so never more than the IANA list has."""
    return [r[0] for r in accounts.select("tz_name").where("tz_name is not null").distinct().collect()]
