"""Time series, as-of joins, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..operators import ranks
from ..operators.lookup import as_of_join
from ..registry import query, table
from ..stages import staged
from .common import AS_OF, SALES, as_of, m, sales


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference price per kind of event and day: the day's first value."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("metal"), F.to_date("ts").alias("day")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("price"))


_SPOT = "spot AS (SELECT event_type AS metal, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS price FROM events GROUP BY 1, 2)"


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, median(value) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def daily_price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


_ASKED = """q AS (SELECT user_id, event_type AS metal, CAST(max(ts) AS DATE) + CAST((user_id % 25) - 40 AS INT) AS day FROM events GROUP BY 1, 2),
s AS (SELECT * FROM spot)"""


@query(f"""WITH {_SPOT}, {_ASKED}, c AS (SELECT q.*, coalesce((SELECT max(s.day) FROM s WHERE s.metal = q.metal AND s.day <= q.day), (SELECT min(s.day) FROM s WHERE s.metal = q.metal)) AS at FROM q)
SELECT c.user_id, c.metal, c.day, CASE WHEN abs(c.day - c.at) <= 7 THEN s.price END AS price, CASE WHEN abs(c.day - c.at) <= 7 THEN c.at END AS matched_day FROM c LEFT JOIN s ON s.metal = c.metal AND s.day = c.at""")
def asof_prior_then_next_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of a metal on a day, as a series that may have gaps knows it."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("metal")).agg(F.to_date(F.max("ts")).alias("day"))
    e = e.withColumn("day", F.date_add("day", (F.col("user_id") % 25 - 40).cast("int")))
    s = spot(spark, sf_dir).withColumnRenamed("day", "d")
    return as_of_join(e, s, ["metal"], "day", "d", "price").select("user_id", "metal", "day", "price", "matched_day")


@query(f"""WITH {_SPOT}, d AS (SELECT event_type AS metal, CAST(ts AS DATE) AS day, median(value) AS median FROM events GROUP BY 1, 2)
SELECT metal, day, d.median, spot.price FROM spot LEFT JOIN d USING (metal, day)""")
def metal_overlay_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference series with the market's median laid over it."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metal"), F.to_date("ts").alias("day")).agg(F.median("value").alias("median"))
    return spot(spark, sf_dir).join(d, ["metal", "day"], "left").select("metal", "day", "median", "price")


def trend(rows: DataFrame, keys: list[str], when: str, price: str, now) -> DataFrame:
    """recent and older upper medians of two years, change in per cent and direction (15 %);
    null without two prices on each side and four in all. Ranks come from summed counts."""
    age = F.when(F.col(when) >= F.add_months(now, -12), "recent").when(F.col(when) >= F.add_months(now, -24), "older")
    counts = rows.where(F.col(price) > 0).withColumn("age", age).where("age is not null").groupBy(*keys, "age", price).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys, "age")
    counts = counts.withColumn("upto", F.sum("c").over(w.orderBy(price))).withColumn("n", F.sum("c").over(w))
    upper = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(price)))
    sides = counts.groupBy(*keys, "age").agg(upper.alias("v"), F.max("n").alias("n")).where("n >= 2")
    out = sides.groupBy(*keys).agg(F.max(F.when(F.col("age") == "recent", F.col("v"))).alias("recent"), F.max(F.when(F.col("age") == "older", F.col("v"))).alias("older"))
    pct = F.floor((F.col("recent") - F.col("older")) / F.col("older") * 1000 + 0.5) / 10
    out = out.withColumn("pct", pct)
    return out.withColumn("direction", F.when(F.col("pct") >= 15, "rising").when(F.col("pct") <= -15, "falling").when(F.col("pct").isNotNull(), "stable"))


@query(f"""WITH {SALES}, t AS (SELECT brand, price, CASE WHEN sold >= TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH THEN 'recent' WHEN sold >= TIMESTAMP '{AS_OF}' - INTERVAL 24 MONTH THEN 'older' END AS age FROM sales WHERE price > 0),
l AS (SELECT brand, age, list(price ORDER BY price) AS p FROM t WHERE age IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT brand, max(p[len(p) // 2 + 1]) FILTER (age = 'recent') AS recent, max(p[len(p) // 2 + 1]) FILTER (age = 'older') AS older FROM l GROUP BY 1),
c AS (SELECT *, floor((recent - older) / older * 1000 + 0.5) / 10 AS pct FROM s)
SELECT *, CASE WHEN pct >= 15 THEN 'rising' WHEN pct <= -15 THEN 'falling' WHEN pct IS NOT NULL THEN 'stable' END AS direction FROM c""")
def trend_12m_vs_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(sales(spark, sf_dir), ["brand"], "sold", "price", as_of())


_CELL = f"""WITH {SALES}, c AS (SELECT brand, year(sold) AS year, median(price) FILTER (quantity >= 10) AS median, count(*) FILTER (quantity >= 10) AS sold, list(price ORDER BY price) FILTER (quantity < 10) AS asks FROM sales GROUP BY 1, 2)"""


def matrix(rows: DataFrame, axes: list[str], sold, price: str) -> DataFrame:
    """A row per cell: median and number of sold rows, the lowest and the next different price of the others."""
    cells = rows.groupBy(*axes).agg(F.median(F.when(sold, F.col(price))).alias("median"), F.count_if(sold).alias("sold"), F.min(F.when(~sold, F.col(price))).alias("cheapest"))
    asked = rows.where(~sold).select(*axes, F.col(price).alias("_price")).distinct()
    second = asked.withColumn("_nth", F.row_number().over(Window.partitionBy(*axes).orderBy("_price"))).where("_nth <= 2")
    return cells.join(second.where("_nth = 2").select(*axes, F.col("_price").alias("next_price")), axes, "left")


def completed(cells: DataFrame, down: str, across: str) -> DataFrame:
    """``cells`` and an empty one for each pair of values on the two axes that has none: a dense matrix."""
    return cells.select(down).distinct().crossJoin(cells.select(across).distinct()).join(cells, [down, across], "left")


def summaries(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each matrix (``keys``; cells with year, median, sold) in a row: cells, priced ones, sales, first and last year, upper median and
    mean of the cells' medians, coverage in per cent."""
    counts = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.count("median").alias("priced"), F.sum("sold").alias("sales"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        money(F.avg(F.col("median").cast("decimal(18,4)")).cast("double")).alias("mean"), (F.floor(F.count("median") * 1000.0 / F.count(F.lit(1)) + 0.5) / 10).alias("coverage"),
    )
    return counts.join(ranks.upper_medians(cells, keys, "median"), keys, "left")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(sales(spark, sf_dir).withColumn("year", F.year("sold").cast("bigint")), ["brand", "year"], F.col("quantity") >= 10, "price")


@query(_CELL + " SELECT brand, year, median, sold, asks[1] AS cheapest FROM c")
def year_attr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year by brand: median and count of sold rows (ten pieces or more), lowest price asked."""
    return _cells(spark, sf_dir).drop("next_price")


@query(f"WITH {SALES} SELECT kind, count(*) AS n, median(price) AS median FROM sales GROUP BY kind ORDER BY n DESC")
def brand_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.median("price").alias("median")).orderBy(F.desc("n"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"WITH {SALES} SELECT brand, " + ", ".join(f"median(price) FILTER (kind = '{t}') AS {t.lower()}" for t in _TYPES) + " FROM sales GROUP BY brand")
def matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sales(spark, sf_dir).groupBy("brand").pivot("kind", _TYPES).agg(F.median("price"))
    return out.select("brand", *[F.col(t).alias(t.lower()) for t in _TYPES])


@query(_CELL + """, s AS (SELECT count(*) AS cells, count(*) FILTER (median IS NOT NULL) AS filled, count(DISTINCT brand) * count(DISTINCT year) AS possible, list(median ORDER BY median) FILTER (median IS NOT NULL) AS l FROM c)
SELECT cells, filled, floor(filled * 1000.0::DOUBLE / possible + 0.5) / 10 AS coverage, l[len(l) // 2 + 1] AS upper_median FROM s""")
def matrix_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, coverage in per cent and the upper median of the cells' medians."""
    c = year_attr_matrix(spark, sf_dir)
    c = staged(c, "cells")
    cells = c.agg(F.count(F.lit(1)).alias("cells"), F.count("median").alias("filled"), (F.countDistinct("brand") * F.countDistinct("year")).alias("possible"))
    upper = ranks.upper_medians(c, [], "median").first()[0]
    return cells.select("cells", "filled", (F.floor(F.col("filled") * 1000.0 / F.col("possible") + 0.5) / 10).alias("coverage"), F.lit(upper).cast("double").alias("upper_median"))


@query(_CELL + """, g AS (SELECT b.brand, y.year, c.median, coalesce(c.sold, 0) AS sold FROM (SELECT DISTINCT brand FROM c) b CROSS JOIN (SELECT DISTINCT year FROM c) y LEFT JOIN c ON c.brand = b.brand AND c.year = y.year),
l AS (SELECT brand, count(*) AS cells, count(median) AS priced, CAST(sum(sold) AS BIGINT) AS sales, min(year) AS first_year, max(year) AS last_year, avg(median::DECIMAL(18,4)) AS a, list(median ORDER BY median) FILTER (median IS NOT NULL) AS l FROM g GROUP BY brand)
SELECT brand, cells, priced, sales, first_year, last_year, floor(a::DECIMAL(22,8)::DOUBLE * 100 + 0.5) / 100 AS mean, floor(priced * 1000.0::DOUBLE / cells + 0.5) / 10 AS coverage, l[len(l) // 2 + 1] AS upper_median FROM l""")
def matrix_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's dense matrix of years in a row, for comparisons."""
    cells = staged(completed(_cells(spark, sf_dir), "brand", "year").na.fill(0, ["sold"]), "cells")
    return summaries(cells, ["brand"])


@query(f"""WITH {SALES}, r AS (SELECT brand, kind, price, row_number() OVER (PARTITION BY brand, kind ORDER BY price) AS nth FROM (SELECT DISTINCT brand, kind, price FROM sales)) SELECT brand, kind, max(price) FILTER (nth = 1) AS cheapest, max(price) FILTER (nth = 2) AS next_price FROM r WHERE nth <= 2 GROUP BY 1, 2""")
def two_cheapest_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales(spark, sf_dir).select("brand", "kind", "price").distinct()
    nth = F.row_number().over(Window.partitionBy("brand", "kind").orderBy("price"))
    r = rows.withColumn("nth", nth).where("nth <= 2")
    return r.groupBy("brand", "kind").agg(F.max(F.when(F.col("nth") == 1, F.col("price"))).alias("cheapest"), F.max(F.when(F.col("nth") == 2, F.col("price"))).alias("next_price"))


@query(f"""WITH {SALES}, y AS (SELECT part_key, year(sold) AS year, median(price) AS median, count(*) AS n FROM sales GROUP BY 1, 2)
SELECT a.part_key, a.year, count(*) AS neighbours, {m("CAST(avg(CAST(b.median AS DECIMAL(18,3))) AS DECIMAL(18,4))")}::DOUBLE AS value FROM y a JOIN y b ON b.part_key = a.part_key AND b.year <> a.year AND abs(b.year - a.year) <= 2 WHERE a.n < 3 AND b.n >= 2 GROUP BY 1, 2""")
def nearest_adjacent_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thin year's value from the years beside it, by an equi-join on shifted years."""
    y = sales(spark, sf_dir).groupBy("part_key", F.year("sold").cast("bigint").alias("year")).agg(F.median("price").alias("median"), F.count(F.lit(1)).alias("n"))
    thin = y.where("n < 3").select("part_key", "year", F.explode(F.array(*[F.col("year") + d for d in (-2, -1, 1, 2)])).alias("other"))
    rich = y.where("n >= 2").select("part_key", F.col("year").alias("other"), "median")
    return thin.join(rich, ["part_key", "other"]).groupBy("part_key", "year").agg(F.count(F.lit(1)).alias("neighbours"), money(F.avg(F.col("median").cast("decimal(18,3)")).cast("decimal(18,4)")).cast("double").alias("value"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, median(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS before FROM d)
SELECT event_type, day, floor((v - before) / before * 1000 + 0.5) / 10 AS pct, CASE WHEN abs((v - before) / before) > 0.25 THEN 'red' WHEN abs((v - before) / before) > 0.1 THEN 'yellow' ELSE 'ok' END AS status FROM p WHERE before > 0""")
def drift_vs_prior_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.median("value").alias("v"))
    p = d.withColumn("before", F.lag("v").over(Window.partitionBy("event_type").orderBy("day"))).where("before > 0")
    change = (F.col("v") - F.col("before")) / F.col("before")
    return p.select("event_type", "day", (F.floor(change * 1000 + 0.5) / 10).alias("pct"), F.when(F.abs(change) > 0.25, "red").when(F.abs(change) > 0.1, "yellow").otherwise("ok").alias("status"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts")
def series_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days of a series."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), e.ts >= last["last"] - F.expr("interval 7 days")).select("event_type", F.to_date("ts").alias("day"), "value")


@query("SELECT event_type, max(ts) AS last_at, arg_max(value, (ts, event_id)) AS value, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last_at"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.countDistinct("user_id").alias("keys"))
