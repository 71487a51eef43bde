from pyspark.sql import functions as F

from daypanel.llm import language


def test_copies_leave_room_for_other_texts(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    alone = [(f"stone {word(i)} garden", "zz") for i in range(49)]
    copies = spark.range(20_000).select(F.lit("one text that is everywhere").alias("text"), F.lit("zz").alias("lang"))
    df = copies.unionByName(spark.createDataFrame(alone, "text string, lang string"))
    ((lang, sample),) = language.learn(df)
    assert lang == "zz" and sample.count("everywhere") == 1
    assert all(word(i) in sample for i in range(49))


def test_sample_holds_the_smallest_hashes(spark):
    df = spark.range(5_000).select(F.concat(F.lit("text "), F.translate("id", "0123456789", "abcdefghij")).alias("text"), F.lit("zz").alias("lang"))
    ((_, sample),) = language.learn(df)
    first = df.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).limit(language.SAMPLE_ROWS).collect()
    assert sorted(sample.removeprefix("text ").split(" text ")) == sorted(r["text"].removeprefix("text ") for r in first)
