"""Rules and reputations; the registered query is compared with SQL in the parity test."""

import re

from pyspark.sql import functions as F

from foldwise.llm import urls
from foldwise.llm.queries import URL_RULES

URLS = [
    "http://WWW.Example.com/en/x?q#f", "https://example.com/en/", "http://a.net/es/1", "http://net/fr/",
    "http://example.com", "ftp://host.org?x=/en/", "no scheme at all", "", None, "http://notexample.com/en/",
    "http://xnet/es/", "//a.com/", "http://ÉXAMPLE.com/EN/", "http://1.2.3.4/es/", "http://a.co.uk/\n/x",
    "http://u.example.com/en/a://b.net/es/",
]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), v, h + p)
        for v, h, p in URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "allow"


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    pages = pages.withColumns({"host": F.lit("clash"), "path": F.lit("clash"), "id": F.lit(1)})
    none = spark.createDataFrame([], "id long, bad int")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, none, "page_id", "url", URL_RULES).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(URLS)}
    assert urls.judge_urls(pages.where("false"), none, "page_id", "url", URL_RULES).collect() == []


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [(i, f"http://bad.spam.org/{i}", 1) for i in range(40)]
    rows += [(100 + i, f"http://good{i % 9}.fine.org/{i}", 0) for i in range(200)]
    rows += [(400, "http://new.spam.org/", None), (401, "http://one.fine.org/", 1), (None, "http://x.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int")
    outcomes = pages.where("bad is not null").selectExpr("page_id AS id", "bad")
    judged = urls.judge_urls(pages, outcomes, "page_id", "url", [("allow", "nothing", "/")])
    verdicts = {r.id: r.verdict for r in judged.collect()}
    assert all(verdicts[i] == "block" for i in range(40))
    assert all(verdicts[100 + i] == "allow" for i in range(200))
    assert verdicts[401] == "allow"  # one bad page is not enough
    hosts = urls.with_host_and_path(pages, "url").select("host", "bad")
    rates = {r.host: r for r in urls.host_reputations(hosts).collect()}
    assert rates["new.spam.org"].rate > rates["one.fine.org"].rate > rates["good1.fine.org"].rate
    by_host = {r.host: r for r in judged.collect()}
    assert by_host["bad.spam.org"].n == 40 and by_host["bad.spam.org"].lower > 0.5
    assert all(r.lower < r.rate == rates[r.host].rate for r in by_host.values())
    strict = urls.judge_urls(pages, outcomes, "page_id", "url", [], max_bad=0.0)
    assert {r.verdict for r in strict.where("host = 'bad.spam.org'").collect()} == {"block"}


def test_no_rules_empty_tables_and_repeated_pages(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (2, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1)], "id long, bad int")
    judged = urls.judge_urls(pages, outcomes, "page_id", "url", []).collect()
    assert sorted((r.id, r.host, r.path, r.rule, r.n) for r in judged) == [
        (1, "a.org", "/x", None, 2), (1, "a.org", "/x", None, 2), (2, "", "", None, 0)
    ]
    assert all(r.verdict == ("block" if r.lower > 0.5 else "allow") for r in judged)
    assert urls.judge_urls(pages.where("false"), outcomes, "page_id", "url", []).collect() == []
    assert urls.judge_urls(pages.where("false"), outcomes.where("false"), "page_id", "url", URL_RULES).collect() == []
    assert len(urls.judge_urls(pages, outcomes.where("false"), "page_id", "url", URL_RULES).collect()) == 3
