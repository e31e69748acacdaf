import random
import re

from blockprep.llm import urls
from blockprep.llm.queries import SITE_RULES, URL_PATTERNS

LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", after).group()
    rest = after[len(host) :]
    return host.translate(LOWER), re.match("[^?#]*", rest).group(), rest


def as_regex(pattern):
    body = re.sub(r"\|$", "", re.sub(r"^\|\|?", "", pattern))
    out = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
    front = r"^(?:[^/?#]*\.)?" if pattern.startswith("||") else "^" if pattern.startswith("|") else ""
    return re.compile(front + out + (r"\Z" if pattern.endswith("|") else ""), re.S)


def judged(url, rules, patterns):
    host, path, rest = parts(url)
    if not host + rest:
        return host, path, None, None, "allow"
    site = [
        (len(r), v == "block", v, r)
        for r, v in rules
        if (host == (h := r.split("/")[0].lower()) or host.endswith("." + h)) and path.startswith(r[len(h) :])
    ]
    other = [(len(p), v == "block", v, p) for p, v in patterns if as_regex(p).search(host + rest)]
    if site:
        return host, path, max(site)[3], None, max(site)[2]
    return (host, path, None, max(other)[3], max(other)[2]) if other else (host, path, None, None, "allow")


def check(spark, rows, rules, patterns):
    docs = spark.createDataFrame(rows, "page_id long, url string, host int, `a.b` string, token string, S string")
    found = urls.filter_urls(docs, urls.rule_table(spark, rules), urls.rule_table(spark, patterns), spread_by="page_id")
    assert found.columns == ["page_id", "url", "a.b", "token", "S", "host", "path", "rule", "pattern", "verdict"]
    got = sorted((r[0] or 0, r[1] or "", r[5:]) for r in map(tuple, found.collect()))
    assert got == sorted((r[0] or 0, r[1] or "", judged(r[1], rules, patterns)) for r in rows)


ODD = [
    None, "", "no scheme/en/", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/x", "http://example.com/EN/",
    "http://example.com:80/en/", "http://notexample.com/en/", "http://com/", "http://com", "http://com?/", "x://net/es/?q=/en/",
    "a://b.net/fr/://c.com/en/", "http://a.net#/es/", "http://ads-track.example.org/x", "http://m.a.org/x/print/",
    "http://a.org/search?q=1&sessionid=3", "http://a.org/logins", "http://a.org/login", "http://blog.a.org/de/7.html",
    "http://blog.a.org/de/7.htmlx", "http://é.org/ünder/en\n.exe", "http://a.org/" + "x1/" * 30_000 + "b.zip",
]


def test_odd_urls(spark):
    rows = [(i, u, i, "x", "en", "s") for i, u in enumerate(ODD)] + [(None, ODD[5], 0, None, None, None)] * 2
    check(spark, rows, SITE_RULES, URL_PATTERNS)
    check(spark, rows, [], [])
    check(spark, rows, [("org", "block"), ("a.org/s", "allow"), ("A.org/s", "allow")], [("x*1", "block"), ("*", "allow"), ("*", "block"), ("", "block")])


def test_random_urls_and_rules(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab1.-_%") for _ in range(rng.randrange(1, 4)))
    rows = [
        (i, f"http://{word()}.{word()}/{word()}/{word()}{rng.choice(['', '?', '#'])}{word()}", 0, "", "", "")
        for i in range(400)
    ]
    make = lambda: rng.choice(["", "|", "||"]) + rng.choice(["", "*", "^"]).join([word(), word()]) + rng.choice(["", "|", "^", "/"])
    check(spark, rows, [], list({make(): rng.choice(["allow", "block"]) for _ in range(60)}.items()))


def test_rules_are_filed_under_their_rarest_token(spark):
    made = urls.compiled(urls.rule_table(spark, SITE_RULES), urls.rule_table(spark, [("ab*cd", "block"), ("||ab.cd", "block")]))
    targets = spark.createDataFrame([("www.example.com/en/",), ("a.example.com/",), ("b.net/en/",)], "target string")
    found = {r["rule"]: r["token"] for r in urls.rarest_tokens(made, targets, True).collect()}
    assert found["www.example.com/en/"] == "www" and found["com/"] == "com" and found["net/es/"] == "es"
    assert found["ab*cd"] == "" and found["||ab.cd"] == "ab"


def test_one_url_holds_most_rows_and_nothing_is_python(spark):
    rows = [(i, "http://a.net/es/1" if i % 3 else f"http://b{i}.org/", 0, "", "", "") for i in range(600)]
    check(spark, rows, SITE_RULES, URL_PATTERNS)
    docs = spark.createDataFrame(rows[:5], "page_id long, url string, h int, a string, b string, c string").where("page_id < 0")
    found = urls.filter_urls(docs, urls.rule_table(spark, SITE_RULES), urls.rule_table(spark, URL_PATTERNS), spread_by="page_id")
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
