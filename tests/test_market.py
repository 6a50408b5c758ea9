"""Finishes, scores, routes and the entry point without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hammerprice.operators import audit, dims, intent, market, score, variants

ROOT = Path(__file__).resolve().parents[1]


def values(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_families(spark):
    got = values(spark, variants.families, "Reverse Proof eagle", "proof-like", "Proof, gilded", None, "Ultra High Relief privy", "enhanced reverse-proof")
    assert got == [["reverseProof"], [], ["proof", "gilded"], [], ["privy", "highRelief"], ["reverseProof"]]
    assert values(spark, variants.requested_family, "colorized eagle", "antiqued and gilded", "eagle", None) == ["colorized", "ambiguous", None, None]


def test_first_match_of_rolls(spark):
    assert values(spark, dims.roll_quantity, "Lunar Kangaroo", "lunar maple leaf", "Lunar Panda", "lunar", "Barber dime", "token") == [25, 25, 30, 20, 50, None]


def test_composition(spark):
    clad = lambda t: variants.composition_mismatch(t, F.lit("Washington quarter"), F.lit(1976))
    asked = lambda t: variants.composition_mismatch(t, F.lit("Washington quarter silver"), F.lit(1976))
    old = lambda t: variants.composition_mismatch(t, F.lit("Kennedy half dollar"), F.lit(1964))
    assert values(spark, clad, "1976 quarter", "1976 90% quarter", None) == [False, True, False]
    assert values(spark, asked, "1976 quarter", "1976 silver quarter") == [True, False]
    assert values(spark, old, "1964 half", "clad half", "copper-nickel") == [False, True, True]


def test_rules_in_order(spark):
    titles = ["2 pesos libertad", "Geiger bar 10 oz", "Perth Mint 1 oz type 1", "Perth Mint 1 oz colorized", "Perth Mint buffalo nickel", "Perth Mint 1 oz MS65 NGC", "Perth Mint 1 oz MS65 PCGS"]
    wanted = {"weight": F.lit(1.0), "brand": F.lit("Perth Mint"), "label": F.lit("Type 2"), "series": F.lit("Jefferson"), "grade": F.lit("MS65"), "pcgs_only": F.lit(True), "grade_only": F.lit(True)}
    df = audit.removed_by(spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string"), audit.listing_rules(F.col("title"), wanted))
    assert [r["removed_by"] for r in df.orderBy("i").collect()] == ["nonBullionDenom", "wrongBrand", "typeMismatch", "variantMismatch", "seriesConflict", "pcgsOnly", None]


def test_scores(spark):
    plain = lambda t: score.coin(t, {"year": F.lit(1921), "grade": F.lit("MS65"), "mint": F.lit("S"), "series": F.lit("Morgan Dollar")})
    # 50, slab 5, grade 15, year 15, mint 10, series 10: capped at 100
    assert values(spark, plain, "1921-S Morgan Dollar PCGS MS65", "1921-D Morgan Dollar PCGS MS63", "Peace token") == [100, 50 + 5 + 5 - 30 + 15 - 30 + 10, 50 - 20 - 25 - 50]
    made = lambda t: score.bar(t, {"brand": F.lit("PAMP"), "size": F.lit("2.5 gram"), "bar_series": F.lit("lunar"), "found_series": F.lit("fortuna")})
    assert values(spark, made, "pamp 2.5g bar", "bar") == [75, 15]


def test_market_rules(spark):
    assert values(spark, lambda t: market.weight_token(t.cast("double")), "0.5", "2", "1.5", "0.049", None) == ["half oz", "2oz", None, "twentieth oz", None]
    assert values(spark, market.brand, "Argor Heraeus", "Royal Mint", "jm bar", None) == ["Argor-Heraeus", "Royal Mint", "JM", "Generic"]
    rows = spark.createDataFrame([("AU58",), ("RAW",), ("MS65",), ("MS70",), ("??",)], "g string")
    assert [r["g"] for r in rows.orderBy(market.grade_rank(F.col("g"))).collect()] == ["RAW", "MS70", "MS65", "AU58", "??"]
    data = spark.range(1000).withColumn("golden", F.col("id") < 5)
    one, again = (market.sampled(data.repartition(n), "id", 0.1, 7, data.where("golden")) for n in (1, 5))
    assert sorted(one.collect()) == sorted(again.collect()) and 5 <= one.count() <= 200 and one.where("golden").count() == 5


def test_bulk_items(spark):
    got = values(spark, lambda t: intent.bulk_items(t, 3), '["a \\"b\\"", {"coin": "c", "qty": "3"}, {"x": 1, "quantity": 0}]', "no", None, "[]")
    assert [x and [tuple(i) for i in x] for x in got] == [[('a "', True, 1), ("c", False, 3), ("", False, 1)], None, None, []]


def test_profiles_of_nothing(spark):
    assert [tuple(x) for x in values(spark, intent.metal_profile, None, "", "coin -gold", "Gold coin")] == [(False, None), (False, None), (False, None), (True, "gold")]
    assert values(spark, intent.composition, None, "1943 war nickel", "indian cent eagle") == ["unknown", "silver-numismatic", "unknown"]


def test_ghosts_by_turned_words(spark):
    rows = [("2011 mexico 1oz silver libertad", 4, 0), ("2011 mexican silver libertad 1oz bu", 1, 9), ("x", None, None), ("2011 eagle", 7, 0), ("2011 eagle 1oz", None, 2)]
    df = spark.createDataFrame([(k, d, None, None, None, None, n) for k, d, n in rows], "key string, deep_at int, page1_at int, last_refresh int, newest int, oldest int, n int")
    assert {r["key"]: r["deep_at"] for r in intent.pruned(df, F.lower).collect()} == {"2011 mexican silver libertad 1oz bu": 1, "2011 eagle 1oz": 7}


def test_empty_titles_are_no_copies(spark):
    from hammerprice.operators import merge

    df = spark.createDataFrame([(1, None, ""), (2, None, ""), (3, 7, "a"), (4, 7, "b"), (5, 8, "a")], "n int, item int, print string")
    assert sorted(r["n"] for r in merge.dedup_or(df, "item", "print", "n").collect()) == [1, 2, 3]


@pytest.mark.skipif(not (ROOT / "hammerprice" / "llm").exists(), reason="already without")
def test_entry_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "hammerprice", tmp_path / "hammerprice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for pipeline in (False, True):
        if pipeline:
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op1_') for n in q))"], cwd=tmp_path, capture_output=True, text=True, check=True)
        n, sql, there = said.stdout.split()
        assert int(n) > 100 and int(sql) > 90 and there == "False"


def test_equal_listings_are_scored_once(spark):
    from hammerprice.queries import queries

    plan = queries()["coin_match_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan and "Join Inner" in plan
