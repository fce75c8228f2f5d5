"""Upper case of letters that have no single capital."""

from pyspark.sql import functions as F

from lodestream.functions.text import upper_each
from lodestream.operators import business, revisions


def test_every_letter_keeps_its_place_in_upper_case(spark):
    given = {"straße": "STRAẞE", "ßß": "ẞẞ", "ﬁne oﬃce": "ﬁNE OﬃCE", "ᾳb": "ᾼB", "äöü é": "ÄÖÜ É", "": "", None: None, "plain": "PLAIN"}
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert {r["t"]: r["u"] for r in df.select("t", upper_each(F.col("t")).alias("u")).collect()} == given


def test_codes_beside_a_sharp_s_are_found(spark):
    df = spark.createDataFrame([(1, "underßtever"), (2, "ßunder, license"), (3, "thunder")], "i int, t string")
    codes = spark.createDataFrame([("Under",), ("license",)], "c string")
    found = business.rows_naming_codes(df, "t", codes, "c", "([A-Z]+)").select("i", "code").collect()
    assert sorted(map(tuple, found)) == [(1, "UNDER"), (2, "LICENSE"), (2, "UNDER")]


def test_tags_with_a_sharp_s_are_not_those_with_two(spark):
    df = spark.createDataFrame([("d", "A", "maß, masse"), ("d", "B", "mass; masse")], "doc string, rev string, tags string")
    out = revisions.revision_timeline(df.withColumn("s", F.lit("x")), "doc", "rev", ["tags"], "s", "s", "rev").orderBy("place").collect()
    assert [(r["tag_count"], r["added_tags"], r["removed_tags"]) for r in out] == [(2, [], []), (2, ["MASS"], ["MAẞ"])]
