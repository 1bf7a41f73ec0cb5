import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import registry, urlrules

from .helpers import FOLDER

PIECE = st.sampled_from(["a", "b", "ab", "com", "x", "é"])
HOST = st.lists(PIECE, min_size=1, max_size=3).map(".".join)
PATH = st.lists(st.sampled_from(["/", "a", "b", "/a", "é"]), max_size=4).map("".join)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = split(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_query_matches_sql(spark):
    duckdb.sql(f"create or replace view pages as select * from '{FOLDER}/pages.parquet'")
    got = [tuple(r) for r in registry.op10_urls(spark, FOLDER).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=repr) == sorted(duckdb.sql(registry.OP10_SQL).fetchall(), key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["block", "allow"]), HOST, PATH.map(lambda p: "/" + p.lstrip("/"))), max_size=25), st.lists(st.tuples(HOST, PATH), min_size=1, max_size=40))
def test_nested_rules(spark, rules, targets):
    urls = [f"http://{h}{p}" for h, p in targets]
    got = urlrules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), urlrules.rule_table(spark, rules)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], rules)


def test_edges(spark):
    urls = [None, "", "nourl", "http://", "HTTP://WWW.Example.COM:80/EN/x?y#z", "a://b://c/d", "http://h?x/en/", "http://com#/en/", "http://com/en/", "http://com/en/", "http://xcom/en/", "http://a.com/en/7"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string").selectExpr("*", "'x' as host", "1 as verdict", "'k' as key")
    rules = [*registry.RULES, ("block", "", "/"), ("allow", None, None)]
    got = urlrules.judge_urls(df, urlrules.rule_table(spark, rules))
    assert set(got.columns) == {"page_id", "url", "host", "path", "rule", "verdict", "key"}
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], registry.RULES), r
    assert urlrules.judge_urls(df.limit(0), urlrules.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in urlrules.judge_urls(df, urlrules.rule_table(spark, rules).limit(0)).collect()} == {"allow"}
