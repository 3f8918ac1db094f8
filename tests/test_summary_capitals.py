"""The first letter of a sentence becomes one capital letter."""

from pyspark.sql import functions as F

from newsdesk.functions import text as T


def test_sharp_s_and_ligatures(spark):
    rest = "ieung und ein langer Satz mit vielen Worten."
    df = spark.createDataFrame([(c + rest,) for c in ("ß", "ä", "ﬁ", "a")], "t string")
    got = [r[0] for r in df.select(T.editorial_summary(F.col("t"), F.lit(""))).collect()]
    assert got == [c + rest for c in ("ẞ", "Ä", "ﬁ", "A")]
