"""Verdicts against brute force over all rules."""
import random
import re

import pytest

from sheetmetric.llm import urls as U


def brute(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url[url.index("://") + 3:]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.key), r.verdict, r.text), default=None)
        out.append((page, host, path, best and best.text, best.verdict if best else default))
    return sorted(out, key=repr)


def found(spark, rows, rules, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS row", "'x' AS verdict").repartition(3)
    table = U.rule_table(spark, tuple(rules)) if rules else U.rule_table(spark).limit(0)
    return sorted(map(tuple, U.judge(df, table, **kw).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


ODD = [None, "", "no scheme", "http://", "http:///x", "://org/", "HTTP://WWW.Example.ORG/es/", "http://org", "http://org/", "http://xorg/", "http://example.org/es", "https://a.example.org/en/1?x=/es/",
       "https://a.example.org/en/12#q", "http://com/fr/", "http://com.com/de/x", "http://a..com/de/", "http://.org/", "http://org./", "http://é.org/ß", "http://a\nb.org/c\nd", "http://u@h.org:80/", "x://a://b.org/", "http://" + "a." * 300 + "com/fr/" + "y" * 5000]


def test_given_rules(spark):
    rows = [(i % 7 or None, u) for i, u in enumerate(ODD + ODD[:3])]
    assert found(spark, rows, U.RULES) == brute(rows, U.RULES)
    assert found(spark, rows, U.RULES, default="block") == brute(rows, U.RULES, "block")
    assert found(spark, rows, []) == brute(rows, [])
    assert found(spark, [], U.RULES) == []


@pytest.mark.parametrize("size", [50_000, 40, 7])
def test_many_rules_and_ranges(spark, size):
    draw = random.Random(size)

    def host(n):
        return ".".join(draw.choice(["a", "b", "ab", "c"]) for _ in range(draw.randrange(1, n)))

    def path(n):
        return "".join("/" + draw.choice(["x", "y", "xy", ""]) for _ in range(draw.randrange(n)))
    rules = {(r.host, r.path, r.verdict): r for r in (U.Rule(draw.choice(["allow", "block"]), host(4) + path(4)) for _ in range(80))}.values()
    rows = [(i, draw.choice(["http://", "https://"]) + host(6) + path(6) + draw.choice(["", "?q", "#/x"])) for i in range(250)]
    rows += [(1000 + i, "http://c.ab.a/x/y") for i in range(150)]          # one url has a third of all rows
    assert found(spark, rows, list(rules), rows_per_range=size) == brute(rows, rules)
