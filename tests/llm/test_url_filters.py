"""URL rules and path templates: pinned cases, planted hosts, and the SQL over the same rows."""

import duckdb
import pytest

from quire.llm.oracle import ORACLE_SQL
from quire.llm.url_filters import judge_urls

SCHEMA = "page_id long, url string"


def judge(spark, urls, rules=None):
    rows = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    if rules is not None:
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: r for r in judge_urls(rows, rules).collect()}


PINNED = [
    ("http://WWW.Example.ORG/es/7?x=1", "www.example.org", "/es/7", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/22#top", "example.org", "/en/22", "org/", "allow"),
    ("http://notexample.org/es/7", "notexample.org", "/es/7", "org/", "allow"),
    ("https://a.b.com/fr/1", "a.b.com", "/fr/1", "com/fr/", "allow"),
    ("https://a.b.com/de/", "a.b.com", "/de/", "com/de/", "block"),
    ("https://a.b.com/de", "a.b.com", "/de", None, None),
    ("http://example.org", "example.org", "", None, None),
    ("http://example.org?q=/es/", "example.org", "", None, None),
    ("HTTP://É.ORG/a b\n/c", "É.org", "/a b\n/c", "org/", "allow"),
    ("no scheme/es/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("://", "", "", None, None), ("x://y://z.org/", "y:", "//z.org/", None, None),
]


def test_hosts_paths_and_rules(spark):
    got = judge(spark, [p[0] for p in PINNED])
    for i, (_, host, path, rule, verdict) in enumerate(PINNED):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")


def planted():
    """One host: numbered articles in two similar sections, slugs that are all different, and a section that rules mostly block."""
    urls = [f"http://h.test/{lang}/{i}.html" for lang in ("aa", "bb") for i in range(40)]
    urls += [f"http://h.test/blog/word{chr(97 + i % 26)}{chr(97 + i // 26)}/view" for i in range(60)]
    urls += [f"http://h.test/bad/{i}/x" for i in range(30)] + [f"http://h.test/bad/{i}/y" for i in range(30)]
    return urls


RULES = [("h.test", "/bad/1", "block"), ("h.test", "/bad/2", "block"), ("h.test", "/aa/1", "allow"), ("h.test", "/blog/worda", "allow")]


def test_templates_and_shares(spark):
    urls = planted()
    got = judge(spark, urls, RULES)
    named = {u: got[i] for i, u in enumerate(urls)}
    assert named["http://h.test/aa/30.html"].template == named["http://h.test/bb/30.html"].template == "/*/#.html"  # alike below, labels agree
    assert named["http://h.test/blog/wordba/view"].template == "/blog/*/view"  # no slug stands often
    bad = named["http://h.test/bad/5/x"]
    assert bad.rule is None and bad.verdict == "block" and bad.template == "/bad/#/*" and bad.labelled == 44
    assert named["http://h.test/bb/3.html"].verdict == named["http://h.test/blog/wordba/view"].verdict == "allow"


def test_hosts_without_labels_take_their_site(spark):
    rules = [("a.s.test", "/", "block")]
    got = judge(spark, ["http://a.s.test/x"] * 9 + ["http://b.s.test/x", "http://other.com/x"] + ["http://c.org/x"] * 30, [*rules, ("org", "/", "allow")])
    assert got[9].verdict == "block" and got[10].verdict == "allow"


def test_deep_and_long_paths_empty_table_and_clashing_names(spark):
    got = judge(spark, ["http://a.com/" + "s/" * 5000, "http://a.com/" + "y" * 300_000, "http://a.com//"])
    assert got[0].template.endswith("/**") and len(got[1].path) == 300_001
    assert judge(spark, []) == {}
    rows = spark.createDataFrame([(1, "http://a.com/de/1"), (1, "http://a.com/de/1"), (None, None)], SCHEMA)
    for c in ("host", "path", "rule", "verdict", "segments", "n", "node", "at"):
        rows = rows.selectExpr("*", f"7 AS {c}")
    assert sorted(r.verdict for r in judge_urls(rows).where("page_id = 1").collect()) == ["block", "block"]


@pytest.mark.parametrize("own", [False, True])
def test_sql_gives_the_same_rows(spark, own):
    duck = duckdb.connect()
    if own:
        urls = planted() + [p[0] for p in PINNED] + [f"http://x{i % 3}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(90)] + [f"http://x{i % 3}.com/en/{i}" for i in range(60)]
        rows = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
        pages = rows.toArrow()  # noqa: F841  DuckDB reads it by its name
    else:
        rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
        duck.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.1/pages.parquet'")
    found = judge_urls(rows)
    result = duck.execute(ORACLE_SQL["op12_path_template_tree"])
    order = [[d[0] for d in result.description].index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in result.fetchall()), key=repr)
