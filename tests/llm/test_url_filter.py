"""URL rules in the plan and as a table, against plain loops."""

import random
import re

import pytest

from pulsegrain.llm import queries, url_filter


def plain(url, rules):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [r for r in rules if r.name and (host == (h := r.name.split("/", 1))[0] or host.endswith("." + h[0])) and path.startswith("/" + h[1])]
    if fits:
        best = min(fits, key=lambda r: (-len(r.name), r.name))
        return host, path, best.name, best.action
    for r in rules:
        if not r.name and re.search(r.pattern, host + path):
            return host, path, None, r.action
    return host, path, None, "allow"


@pytest.mark.parametrize("in_plan", [0, 256])
def test_both_forms_of_the_index(spark, in_plan):
    draw = random.Random(4)
    hosts = ["com", "Example.com", "www.example.com", "a.net", "notexample.com", "buy.cheap-pills.org", "ads1.shop.org", "x-casino.org"]
    paths = ["", "/", "/en/", "/en/a.html", "/es/1", "/fr", "/fr/", "/wp-login.php", "/long" + "/abc" * 20_000]
    urls = [None, "", "no scheme", "a://"] + [f"{s}://{draw.choice(hosts)}{draw.choice(paths)}{q}" for s in ("http", "x") for q in ("", "?a=/en/", "#f") for _ in range(40)]
    rows = spark.createDataFrame([(i % 7, u, "mine", "own", "p", "r", 1) for i, u in enumerate(urls)],
                                 "page_id int, url string, verdict string, _target string, path string, Rule string, _best int")
    out = url_filter.judge_urls(rows.drop("Rule"), queries.URL_RULES, in_plan=in_plan)
    got = sorted(((r.page_id, r.url or "", r._target, r.host, r.path, r.rule or "", r.verdict) for r in out.collect()))
    wanted = []
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u, queries.URL_RULES)
        wanted.append((i % 7, u or "", "own", host, path, rule or "", verdict))
    assert got == sorted(wanted)
    assert url_filter.judge_urls(rows.limit(0), queries.URL_RULES, in_plan=in_plan).count() == 0


def test_many_rules(spark):
    rules = [url_filter.host_rule("block", f"site{i}.org/") for i in range(100_000)]
    urls = [f"http://www.site{i * 1000}.org/x" for i in range(50)] + ["http://site.org/", "http://site100000.org/"] + ["http://site7.org/y"] * 30
    out = url_filter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    assert sorted((r.url, r.verdict) for r in out) == sorted((u, "allow" if u in ("http://site.org/", "http://site100000.org/") else "block") for u in urls)
