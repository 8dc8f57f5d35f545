import random
import re
from itertools import combinations

from courtspark.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x?q=1#y", "https://www.example.com/en/x", "http://a.net/es/", "http://net/fr/z", "http://notnet/fr/z",
    "http://xcom/", "http://com", "http://b.org?x=/en/", "ftp://u@b.ORG:8/en/a#b?c", "a://b://c/d", "http://blog.example.com/EN/", "HTTP://É.Net/fr/", "http://example.com/en/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_given_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS tokens")
    got = {r.page_id: r for r in U.judge(df, spark.createDataFrame([], "url string, block boolean")).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2])
    assert U.judge(df.limit(0), spark.createDataFrame([], "url string, block boolean")).count() == 0


def test_mined_rules_against_brute_force(spark):
    r = random.Random(5)
    seen, rows = [], []
    for _ in range(400):
        host, word = r.choice(["a.org", "b.org", "c.info"]), r.choice(["casino", "news", "win"])
        seen.append(f"https://{host}/{word}/{r.randrange(99)}")
        rows.append((seen[-1], (host != "c.info" and word == "casino" and r.random() < 0.9) or r.random() < 0.05))
    rows += [(None, True), ("http://a.org/x", None)]
    df = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    got = {x.page_id: x for x in U.judge(pages, df, min_support=0.05, min_confidence=0.7).collect()}

    def tokens(url):
        host, path = parts(url)
        labels = host.split(".")
        return {"scheme=https", *(f"host={x}" for x in labels), *("under=" + ".".join(labels[-k:]) for k in range(2, len(labels) + 1)), *(f"path={x}" for x in re.split(r"[/._-]+", path) if x and not x.isdigit())}

    known = [(tokens(u), b) for u, b in rows if u is not None and b is not None]
    rules = {}
    for size in range(1, 7):
        for combo in combinations(sorted(set().union(*(t for t, _ in known))), size):
            has = [b for t, b in known if set(combo) <= t]
            if has and sum(has) >= 0.05 * len(known) and sum(has) / len(has) >= 0.7:
                rules[combo] = sum(has) / len(has)
    assert rules
    for i, url in enumerate(seen):
        best = max((c for k, c in rules.items() if set(k) <= tokens(url)), default=None)
        assert got[i].verdict == ("block" if best else "allow")
        assert best is None and got[i].confidence is None or abs(got[i].confidence - best) < 1e-12


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([("http://a.org/en/12.html",), ("http://a.org/x",), (None,), ("http://a.org/7?page=3",)], "url string")
    labels = spark.createDataFrame([(12, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.url, r.block) for r in U.labels_of_pages(pages, labels).collect()} == {("http://a.org/en/12.html", True), ("http://a.org/7?page=3", False)}
