"""URL filter against a loop over the rules."""

import duckdb
import pytest

from lathe.llm import url_filter as uf

URLS = [
    None, "", "no scheme/at all", "http://", "https://A.B.Example.ORG/es/x", "http://example.org/en/1", "http://example.org/en/12?x#y",
    "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/FR/", "http://com/de/", "http://com", "http://x.com/de/a?b=/fr/",
    "http://x.com?u=http://y.org/es/", "http://x.com#a/fr/", "//x.org/", "ftp://org/", "http://x.net/", "http://.org/", "http://x..org/", "http://x.org:80/", "http://y.com\n/fr/",
    "http://ÉX.example.org/es/", "http://" + "a." * 3000 + "org/" + "p/" * 30000, "http://x.org",
]


def brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


RULES = [("b.c", "/x", "block"), ("c", "/x/y", "allow"), ("a.b.c", "/", "block"), ("c", "", "allow"), ("b.c", "/x/y/z", "allow"), ("d", "", "block")]


@pytest.mark.parametrize("rules", [uf.RULES, RULES])
def test_matches_brute_force(spark, rules):
    urls = URLS + ["http://a.b.c/x/y/z/1", "http://b.c/x/y", "http://c/x/y?z", "http://a.b.c", "http://d", "http://x.d/x", "http://dd"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, urls[4], "h", "r"), (None, urls[5], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(([tuple(r) for r in uf.judge(df, rules, "allow").collect()]), key=str)
    assert got == sorted([(r[0], *brute(r[1], rules, "allow")) for r in rows], key=str)
    assert uf.judge(df.limit(0), rules).collect() == []


def test_sql_form(spark):
    rows = list(enumerate(URLS))
    df = spark.createDataFrame(rows, "page_id long, url string")
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    got = sorted([tuple(r) for r in uf.judge(df).collect()], key=str)
    assert got == sorted(db.execute(uf.judge_sql()).fetchall(), key=str)


def test_host_needed(spark):
    with pytest.raises(ValueError, match="host"):
        uf.judge(spark.createDataFrame([], "page_id long, url string"), [("", "/", "block")])
