import random
import re
import zlib

from pyspark.sql import functions as F

from certlake.llm import common


def test_word_count_and_checksum(spark):
    texts = ["", " ", "a", " a", "a ", "\x0b\x0ca\tb\r\nc ", "é\x1cx y", "\x85", "a" * 5000 + " b"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(" \t\n\x0b\x0c\rab\x1c é") for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("doc_id", common.word_count(F.col("text")).alias("n"), common.doc_crc(F.col("doc_id")).alias("crc")).collect()
    for r in got:
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]))
        assert r["crc"] == zlib.crc32(str(r["doc_id"]).encode())


def test_largest_never_gives_more(spark):
    rows = spark.createDataFrame([(k, float(n)) for k, n in enumerate([1] * 50 + [3, 7, 7, 90, 1000])], "k long, n double")
    for most, want in ((5, {1000, 90, 7, 3}), (4, {1000, 90, 7}), (3, {1000, 90}), (0, set()), (55, {1000, 90, 7, 3, 1})):
        found = common.largest(rows, "n", most).collect()
        assert len(found) <= most and {r["n"] for r in found} == want
    assert common.largest(rows.where("k < 0"), "n", 5).count() == 0
