"""Rules that hold from one value to another, met by equality.

Values are cut into blocks, and those into smaller ones. A rule is posted in the largest blocks that
it covers, a block keeps the one rule that goes before its others, and each distinct value of the
large side looks into the few blocks that hold it. No list of rules and no pair of a rule and a
row is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(rows: DataFrame, rules: DataFrame, keys: list[str], at: str, outputs: list[str], width: int = 16) -> DataFrame:
    """``rows`` with the outputs of the rule that holds at ``at``, null without one.

    ``rules`` has the keys, ``low`` and ``high`` (both included, whole numbers; null is
    open), ``priority`` and the outputs. Of rules that overlap the lowest priority holds, of
    equal ones the narrower, then the later ``low``, then the first output. Keys are whole rows' names of a group
    of rules (none: one group). A rule whose low is above its high holds nowhere. Open ends
    reach as far as the rows do: two numbers are read from them.
    A block is ``width`` (two at least) times as large as those that it is cut into."""
    ends = rows.agg(F.min(at), F.max(at)).first()
    low, high = (0, -1) if ends[0] is None else ends
    first = F.greatest(F.coalesce("low", F.lit(low)), F.lit(low)).cast("bigint")
    last = F.least(F.coalesce("high", F.lit(high)), F.lit(high)).cast("bigint")
    span = F.coalesce(F.col("high") - F.col("low"), F.lit((1 << 63) - 1)).cast("bigint")
    cut = rules.select(*keys, "priority", *outputs, first.alias("_low"), last.alias("_high"), span.alias("_span")).where("_low <= _high")
    sizes, base = [1], max(2, width)
    while sizes[-1] <= high - low:
        sizes.append(sizes[-1] * base)

    def blocks(n: int, begin: str, end: str) -> str:
        return f"transform(CASE WHEN {begin} < {end} THEN sequence({begin}, {end} - 1) ELSE array() END, x -> struct({n} AS n, x AS block))"

    cut = cut.withColumns({"_start": F.col("_low") - low, "_stop": F.col("_high") - low + 1})
    posts = []
    for n, size in enumerate(sizes):
        # Whole blocks of this size inside the rule, without those that a larger block inside it holds.
        a, b, wide = f"(_start + {size - 1}) div {size}", f"_stop div {size}", size * base
        c, d = f"(_start + {wide - 1}) div {wide} * {base}", f"_stop div {wide} * {base}"
        posts.append(F.expr(f"CASE WHEN {c} < {d} THEN concat({blocks(n, a, c)}, {blocks(n, d, b)}) ELSE {blocks(n, a, b)} END"))
    rule = F.struct("priority", "_span", (-F.col("_low")).alias("_later"), *outputs)
    posted = cut.withColumn("_post", F.explode(F.concat(*posts)))
    shelf = posted.groupBy(*keys, F.col("_post.n").alias("_n"), F.col("_post.block").alias("_block")).agg(F.min(rule).alias("_rule"))
    held = F.array(*[F.struct(F.lit(n).alias("_n"), F.expr(f"_point div {size}").alias("_block")) for n, size in enumerate(sizes)])
    asked = rows.select(*keys, at).where(F.col(at).isNotNull()).distinct().withColumn("_point", F.col(at).cast("bigint") - low).select(*keys, at, F.explode(held).alias("_at"))
    met = asked.select(*keys, at, "_at._n", "_at._block").join(shelf, [*keys, "_n", "_block"])
    own = met.groupBy(*keys, at).agg(F.min("_rule").alias("_rule"))
    return rows.join(own, [*keys, at], "left").select(*rows.columns, *[F.col(f"_rule.{o}").alias(o) for o in outputs])


def overridden(rows: DataFrame, overrides: DataFrame, keys: list[str], outputs: list[str]) -> DataFrame:
    """``rows`` whose outputs are replaced by those that ``overrides`` (one row for each key) has, null ones excepted."""
    new = overrides.select(*keys, *[F.col(o).alias(f"_{o}") for o in outputs])
    values = {o: F.coalesce(f"_{o}", o) if o in rows.columns else F.col(f"_{o}") for o in outputs}
    return rows.join(new, keys, "left").withColumns(values).drop(*[f"_{o}" for o in outputs])


#: Designs of the half dollar by year.
DESIGNS = [
    (1964, None, "Kennedy", "Copper-Nickel Clad"),
    (1948, 1963, "Franklin", "90% Silver"),
    (1916, 1947, "Walking Liberty", "90% Silver"),
    (1892, 1915, "Barber", "90% Silver"),
    (1839, 1891, "Seated Liberty", "90% Silver"),
    (1807, 1839, "Capped Bust", "89.24% Silver"),
    (1796, 1807, "Draped Bust", "89.24% Silver"),
    (1794, 1795, "Flowing Hair", "89.24% Silver"),
]
#: What single years have of their own.
YEARS = [(1964, None, "90% Silver"), *[(y, None, "40% Silver") for y in range(1965, 1971)], (1976, "Bicentennial", "Copper-Nickel Clad"), (2026, "Semiquincentennial", "Copper-Nickel Clad")]


def half_dollars(rows: DataFrame, year: str) -> DataFrame:
    """``rows`` with ``design, composition, suffix, label`` of the half dollar of their year; Unknown before 1794, after 2100 and without a year.

    Where two designs share a year the later one is meant."""
    spark = rows.sparkSession
    designs = spark.createDataFrame([(low, high, i, name, metal) for i, (low, high, name, metal) in enumerate(DESIGNS)], "low int, high int, priority int, design string, composition string")
    years = spark.createDataFrame(YEARS, f"{year} int, suffix string, composition string")
    known = F.when(F.col(year).between(1794, 2100), F.col(year))
    found = interval_join(rows.withColumn("_year", known), designs, [], "_year", ["design", "composition"])
    found = overridden(found, years, [year], ["suffix", "composition"])
    sure = F.col("design").isNotNull()
    names = {"design": F.coalesce("design", F.lit("Unknown")), "composition": F.when(sure, F.col("composition")).otherwise("Unknown"), "suffix": F.when(sure, F.col("suffix"))}
    out = found.select(*rows.columns, *[c.alias(n) for n, c in names.items()])
    label = F.concat(F.lit("Half Dollar — "), "design", F.coalesce(F.concat(F.lit(" ("), "suffix", F.lit(")")), F.lit("")))
    return out.withColumn("label", label)
