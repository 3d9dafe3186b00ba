"""Rule lists with upper-case hosts and long paths."""

from __future__ import annotations

from skein.llm import url_filter


def test_upper_case_hosts_and_long_paths(spark):
    long = "/" + "x" * 5000
    rules = spark.createDataFrame([("Example.COM", "/a", "allow"), ("example.com", "/a", "block"), ("Bad.Net", "/", "block"), ("long.org", long, "block")], url_filter.RULE_SCHEMA)
    urls = ["http://www.EXAMPLE.com/a/b", "http://bad.net/x", f"http://long.org{long}/y", "http://long.org/x", "http://other.org/"]
    got = url_filter.judge(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {0: ("example.com/a", "block"), 1: ("bad.net/", "block"), 2: (f"long.org{long}", "block"), 3: (None, "allow"), 4: (None, "allow")}
    assert len(got) == len(urls)
