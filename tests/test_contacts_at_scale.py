"""Contacts that come in one partition, and blocks that hold most of them."""

from pyspark.sql import functions as F

from millrace.functions import contacts as n
from millrace.operators import entity as e


def test_contacts_in_one_partition_are_dealt_anew(spark):
    rows = spark.range(0, 4000, 1, 1).selectExpr("id as row", "concat('Ann', id) as first", "concat('a', id, '@x.example') as email")
    std = e.standardise(rows, {"first": "first", "email": "email"}, "row")
    read = std.select("row", "k").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(read) == 4000 and max(read) < 2000


def test_phonetics_name_each_word_once(spark):
    words = ["Philipp", "Cäcilie", "Schatz", "Xaver", "Axt", "Kxc", "Tsch", "Czech", "Ccx", "Sch", "Chlor", "Wachs", "H", ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(n.cologne(F.col("w"))).collect()]
    assert got == ["351", "485", "88", "4837", "0482", "48", "8", "84", "848", "8", "457", "348", "", ""]
    plan = spark.range(1).selectExpr("string(id) as w").select(n.cologne(F.col("w")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") < 10  # 76 when each letter and rule spelled the word anew


def test_pairs_read_their_keys_once(spark):
    wide = spark.range(3000).selectExpr("id as row", "'name' as kind", "3 as kind_order", "'n:1' as key")
    small = spark.range(41).selectExpr("id as row", "'phone' as kind", "1 as kind_order", "if(id < 40, 'p:1', 'p:2') as key")
    over = spark.range(41).selectExpr("id as row", "'company' as kind", "2 as kind_order", "'c:1' as key")
    mail = spark.createDataFrame([(r, "email", 0, "e:1") for r in (40, 7, 39)], "row long, kind string, kind_order int, key string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    keys = wide.union(small).union(over).union(mail)
    pairs = {(r.a, r.b): (r.via, r.reason) for r in e.candidate_pairs(keys.mapInArrow(count, keys.schema)).collect()}
    assert seen.value == keys.count()
    assert len(pairs) == 40 * 39 // 2 + 2
    assert pairs[7, 39] == (["email", "phone"], "phone") and pairs[7, 40] == (["email"], "email")
