"""A lazy catalogue of the tables in a folder, and SQL over it."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


#: Words of SQL that are not looked up as files.
RESERVED = frozenset("select from where group by order having limit join left right inner outer full on using and or not in is null as with union all distinct case when then else end desc asc between like".split())


class Catalog:
    """Tables ``<folder>/<name>.parquet`` by name; each is opened once, when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.opened: dict[str, DataFrame | None] = {}

    def get(self, name: str) -> DataFrame | None:
        """The table, or None where the folder doesn't have it."""
        if name not in self.opened:
            try:
                self.opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            except AnalysisException:
                self.opened[name] = None
        return self.opened[name]

    def projected(self, name: str, *sets: list[str]) -> DataFrame:
        """The first of the column sets that the stored table has all of."""
        df = self.get(name)
        if df is None:
            raise KeyError(name)
        for columns in sets:
            if set(columns) <= set(df.columns):
                return df.select(*columns)
        raise ValueError(f"{name} has none of the column sets")

    def sql(self, text: str, **values) -> DataFrame:
        """Run SQL over this folder's tables; values bind to :names.

        Each word of the text that names a file of the folder becomes a temporary view, and the text
        is given to Spark as it is, so columns may be named like tables. A quoted path after FROM or JOIN, as in
        ``FROM 'x.parquet'``, is read as a Parquet table.
        """
        text = re.sub(r"(?i)\b(FROM|JOIN)(\s+)'([^']+\.parquet)'", r"\1\2parquet.`\3`", text)
        for name in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", text)):
            if name.lower() not in RESERVED and self.get(name) is not None:
                self.get(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=values or None)
