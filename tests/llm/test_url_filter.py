"""The automaton against plain string matching."""

import fnmatch
import random

from shelfrank.llm.queries import url_rules
from shelfrank.llm.url_filter import Glob, Rule, url_filter


def brute(url, rules, globs, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: (len(r.name), r.verdict == "block"))
        return host, path, best.name, None, best.verdict
    for g in globs:
        if fnmatch.fnmatchcase((host if g.over == "host" else path).replace("[", "("), g.pattern):
            return host, path, None, g.pattern, g.verdict
    return host, path, None, None, default


def urls():
    rng = random.Random(2)
    hosts = ["example.org", "a.example.org", "notexample.org", "org", "x.com", "com", "spam-farm.example.net", "EXAMPLE.org", "ex.org.evil.com",
             "cheap-pills.de", "é.example.org", "host:80", "", "spam.com"]
    paths = ["/", "/es/", "/es", "/es/1", "/en/1", "/en/12/x", "/en/2", "/fr/9", "/de/", "/de/y.example.org/es/", "", "/日本", "//x", "/a\nb", "/x.PDF", "/q.pdf"]
    tails = ["", "?a=/es/", "#top", "?x#y", "/?"]
    out = [rng.choice(["http://", "HTTPS://", "", "a://b://", "x:"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(800)]
    return out + [None, "", "://", "no scheme/es/", "http://example.org/es/" + "x" * 5000, "http://" + "a." * 3000 + "com/de/"]


def check(spark, rules, globs, **kw):
    rows = list(enumerate(urls())) + [(None, "http://a.org/"), (3, urls()[3])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter(df, rules, globs, **kw).collect()
    want = [(i, *brute(u, rules, globs)) for i, u in rows]
    assert sorted(map(str, want)) == sorted(str((r.id, r.host, r.path, r.rule, r.pattern, r.verdict)) for r in got)


def test_contract_rules(spark):
    check(spark, *url_rules())


def test_many_rules_over_several_words(spark):
    rng = random.Random(3)
    rules = [Rule(rng.choice(["allow", "block"]), h, p) for h in ("org", "example.org", "com", "x.com", "evil.com", "de") for p in ("/", "/e", "/en/1", "/de/")]
    globs = [Glob("block", "*pam*"), Glob("block", "h?st*"), Glob("block", "*.pdf", "path"), Glob("block", "/?s*", "path"), Glob("allow", "*")]
    check(spark, rules, globs, batch=7)


def test_no_rules_and_empty_table(spark):
    check(spark, [], [])
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(df, *url_rules()).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "r", 5)], "page_id long, url string, rule string, id int")
    assert url_filter(df, *url_rules()).collect()[0][:] == (1, "a.org", "/x", "org/", None, "allow")
