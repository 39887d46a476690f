"""Measures of layouts that the given tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import layout
from fathomline.plans.define import Plans, Tables

PLANS = Plans()
query = PLANS.query

_NODES = "SELECT s_suppkey AS node, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS x, CAST(floor(s_acctbal / 100) AS DOUBLE) AS y FROM {supplier}"
_EDGES = """SELECT s_suppkey AS a, (s_suppkey * 3 + 1) % n AS b FROM {supplier}, (SELECT count(*) AS n FROM {supplier}) c WHERE s_suppkey <> (s_suppkey * 3 + 1) % n
  UNION ALL SELECT s_suppkey, (s_suppkey + s_nationkey) % n FROM {supplier}, (SELECT count(*) AS n FROM {supplier}) c WHERE s_nationkey > 0"""


def _sql(text: str) -> str:
    return text.replace("{", "").replace("}", "")


def _both(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.spark.sql(_NODES, supplier=t.supplier), t.spark.sql(_EDGES, supplier=t.supplier)


@query(f"""
WITH n AS ({_sql(_NODES)}), e AS (SELECT row_number() OVER () AS e, a, b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by FROM ({_sql(_EDGES)}) g JOIN n p ON p.node = a JOIN n q ON q.node = b),
c AS (SELECT count(*) AS crossing FROM e JOIN e f ON e.e < f.e AND e.a <> f.a AND e.a <> f.b AND e.b <> f.a AND e.b <> f.b
  AND sign((e.bx - e.ax) * (f.ay - e.ay) - (e.by - e.ay) * (f.ax - e.ax)) * sign((e.bx - e.ax) * (f.by - e.ay) - (e.by - e.ay) * (f.bx - e.ax)) < 0
  AND sign((f.bx - f.ax) * (e.ay - f.ay) - (f.by - f.ay) * (e.ax - f.ax)) * sign((f.bx - f.ax) * (e.by - f.ay) - (f.by - f.ay) * (e.bx - f.ax)) < 0)
SELECT crossing, (SELECT count(*) FROM e) AS edges, crossing / (SELECT count(*) * count(*) FROM e) AS fraction FROM c
""")
def layout_crossings(t: Tables) -> DataFrame:
    return layout.crossings(*_both(t))


@query(f"""
WITH RECURSIVE n AS ({_sql(_NODES)}), g AS ({_sql(_EDGES)}), u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM g UNION ALL SELECT b, a FROM g) WHERE a <> b),
w(s, v, d) AS (SELECT DISTINCT a, a, 0 FROM u UNION SELECT w.s, u.b, w.d + 1 FROM w JOIN u ON u.a = w.v WHERE w.d < 12),
d AS (SELECT s, v, min(d) AS d FROM w GROUP BY s, v),
l AS (SELECT d, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS l FROM d JOIN n p ON p.node = s JOIN n q ON q.node = v WHERE d > 0)
SELECT count(*) AS pairs, round(sum(d * ((l - d) / greatest(l, d, 1e-9)) * ((l - d) / greatest(l, d, 1e-9))) / sum(d), 6) AS stress FROM l
""")
def layout_stress(t: Tables) -> DataFrame:
    return layout.stress(*_both(t)).select("pairs", F.round("stress", 6).alias("stress"))
