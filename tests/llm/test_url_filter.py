import sys

from pyspark.sql import functions as F

from stratalens.llm import queries, url_filter
from stratalens.llm.url_filter import bloom_blocks, canonical, judge_urls

sys.path.insert(0, "tests")


def test_query_equals_sql(spark):
    from compare import connect, difference

    folder = "/root/testdata/sf0.001"
    frame = queries.op4_url_filter(spark, folder)
    assert difference(frame, queries.ORACLES["op4_url_filter"], connect(folder)) is None


def test_rules_and_parts(spark):
    urls = [
        "https://a.example.org/es/1", "https://example.org/en/12", "http://example.org/en/2", "https://x.com/fr/a", "https://COM/de/a?b#c",
        "https://notcom/de/", "x://y.org", "http://Ex.ORG/", "no scheme", None, "http://u?q=a://b", "https://badexample.org/es/1", "://a.com/de/",
        "http://h/a\nb?x",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("verdict", F.lit(1))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, pages.limit(0), queries.URL_RULES).collect()}
    assert out == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"),
        2: ("example.org", "/en/2", "org/", "allow"), 3: ("x.com", "/fr/a", "com/fr/", "allow"), 4: ("com", "/de/a", "com/de/", "block"),
        5: ("notcom", "/de/", None, "allow"), 6: ("y.org", "", None, "allow"), 7: ("ex.org", "/", "org/", "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("u", "", None, "allow"), 11: ("badexample.org", "/es/1", "org/", "allow"),
        12: ("a.com", "/de/", "com/de/", "block"), 13: ("h", "/a\nb", None, "allow"),
    }


def test_filter_has_no_false_negatives_and_few_false_positives(spark, monkeypatch):
    listed = spark.range(4000).select(F.concat(F.lit("http://www.h"), F.col("id"), F.lit(".net/p/")).alias("url"))
    pages = spark.range(2000, 12000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://H"), F.col("id"), F.lit(".net:443/p?utm_x=1#f")).alias("url"))
    out = judge_urls(pages, listed.union(listed), [])
    assert {r.page_id for r in out.where("verdict = 'block'").collect()} == set(range(2000, 4000)) and out.count() == 10000
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    assert judge_urls(pages, listed, []).where("verdict = 'block'").count() == 2000
    blocks, count = bloom_blocks(listed.select(canonical(F.col("url")).alias("key")))
    bits = blocks.select(F.sum(F.expr("bit_count(w0) + bit_count(w1) + bit_count(w2) + bit_count(w3)"))).first()[0]
    assert count == 250 and bits / (count * 256) < 0.5


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, none, queries.URL_RULES).collect() == []
