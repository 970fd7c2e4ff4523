from __future__ import annotations

from pyspark.sql import functions as F

from routelore.llm import url_filter


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "x://h.com/fr/1?q#f", "x://h.com?/fr/", "x://com/de/", "x://Example.org/en/1", "x://example.org/en/2", "x://notexample.org/es/",
            "x://a.b.example.org/es/#x", "x://ÄÖ.com/fr/ß\n/y?z", "a://b://c/d", "x://xcom/fr/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages(spark, urls), labels(spark, [])).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "", None, "allow"), ("h.com", "/fr/1", "com/fr/", "allow"),
        ("h.com", "", None, "allow"), ("com", "/de/", "com/de/", "block"), ("example.org", "/en/1", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("notexample.org", "/es/", "org/", "allow"), ("a.b.example.org", "/es/", "example.org/es/", "block"), ("ÄÖ.com", "/fr/ß\n/y", "com/fr/", "allow"), ("b:", "//c/d", None, "allow"), ("xcom", "/fr/", None, "allow")]


def test_bad_hosts_are_blocked_and_shrunk(spark):
    urls = [f"http://bad.site.net/en/{i}" for i in range(40)] + [f"http://good.other.net/en/{100 + i}" for i in range(300)] + ["http://new.third.net/en/9999", "http://one.fourth.net/en/500"]
    rows = [(i, 0, 0) for i in range(40)] + [(100 + i, 1, 0) for i in range(300)] + [(500, 0, 1), (500, 0, 1), (None, 0, 1), (501, None, None)]
    found = url_filter.judged(pages(spark, urls).withColumn("bad", F.lit("clash")), labels(spark, rows)).collect()
    verdicts = {r.host: r.verdict for r in found}
    assert verdicts == {"bad.site.net": "block", "good.other.net": "allow", "new.third.net": "allow", "one.fourth.net": "allow"} and len(found) == len(urls)
    assert {r.host: r.pages for r in found}["one.fourth.net"] == 1


def test_empty(spark):
    assert url_filter.judged(pages(spark, []), labels(spark, [])).collect() == []
