"""URL rules against plain Python, and the cascades' exactness."""

import random

import numpy as np
import pytest

from matchbook.llm import urlfilter
from matchbook.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def brute(pages, rules):
    out = []
    for page, url in pages:
        host, path = split(url)
        fits = []
        for verdict, rule in rules:
            h = rule.split("/", 1)[0]
            p = rule[len(h):]
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(rule), len(h), verdict, rule))
        best = max(fits, default=None)
        out.append((page, host, path, best and best[3], best[2] if best else "allow"))
    return out


def answer(spark, pages, rules, **kw):
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 AS host", "2 AS h1", "3 AS verdict")
    got = urlfilter.judge(df, urlfilter.rule_table(spark, rules), **kw)
    return sorted((tuple(r) for r in got.collect()), key=str)


PAGES = [(1, "http://a.example.org/es/1"), (2, "https://EXAMPLE.org/en/12?x=/es/"), (3, None), (4, ""),
         (5, "no scheme example.org/"), (6, "http://example.org"), (7, "http://example.org?q"),
         (8, "http://example.org#/es/"), (9, "http://notexample.org/es/"), (10, "ftp://x.com/fr/"),
         (11, "http://com/de/"), (12, "http://x.com/DE/"), (13, "http://.org/"), (14, "http://org/"),
         (14, "http://org/"), (15, "http://a..b.org./"), (16, "x://y://z.org/a"), (17, "http:///org/"),
         (None, "http://u@h.com:80/fr/"), (18, "http://é.com/de/ü\n/x"), (19, "://com/fr/" + "a/" * 500_000),
         (20, "http://" + "a." * 100_000 + "org/"), (21, "http://a.com/fr"), (22, "http://example.org/en/1")]


def test_cases_against_plain_rules(spark):
    assert answer(spark, PAGES, URL_RULES) == sorted(brute(PAGES, URL_RULES), key=str)


def test_no_rules_no_pages(spark):
    none = urlfilter.rule_table(spark, URL_RULES).where("false")
    got = urlfilter.judge(spark.createDataFrame(PAGES, SCHEMA), none).collect()
    assert len(got) == len(PAGES) and {(r.rule, r.verdict) for r in got} == {(None, "allow")}
    assert answer(spark, [], URL_RULES) == []


def test_both_verdicts_block_and_bad_rules(spark):
    rules = [("allow", "org/"), ("block", "org/"), ("allow", "org/"), ("allow", "com")]
    pages = [(1, "http://x.org/"), (2, "http://b.com"), (3, "http://b.com?x")]
    assert [r[3:] for r in answer(spark, pages, rules)] == [("org/", "block"), ("com", "allow"), ("com", "allow")]
    with pytest.raises(ValueError):
        answer(spark, pages, [("allow", "/x")])
    with pytest.raises(ValueError):
        answer(spark, pages, [("maybe", "x/")])


@pytest.mark.parametrize("limit, shard_keys", [(64 << 20, 1 << 18), (600, 50)])
def test_many_rules_in_shards_and_passes(spark, limit, shard_keys):
    """Long lists, as one cascade and as many shards sent in several bounded passes."""
    rng = random.Random(5)
    hosts = [f"h{i}.{t}" for i in range(300) for t in ("net", "org", "co.uk")]
    rules = list({r: (rng.choice(["allow", "block"]), r) for r in (
        rng.choice(hosts) + rng.choice(["/", "/a", "/a/b", "/c/", ""]) for _ in range(700))}.values())
    pages = [(i, "http://" + rng.choice(["", "w.", "x.y."]) + rng.choice(hosts)
              + rng.choice(["/a/b/c", "/c/d", "/b", "", "/a"])) for i in range(3000)]
    assert answer(spark, pages, rules, limit=limit, shard_keys=shard_keys) == sorted(brute(pages, rules), key=str)


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 1 << 64, 30_000, dtype=np.uint64) for _ in range(2))
    listed = np.zeros(len(h1), bool)
    listed[:1000] = True
    first = urlfilter.make_filter(h1[listed], h2[listed], 0, 3)
    wrong = urlfilter.passes(h1, h2, 0, *first) & ~listed
    upper = urlfilter.upper_levels((h1[listed], h2[listed]), (h1[wrong], h2[wrong]))
    assert wrong.sum() > 500 and len(upper) > 3
    assert (urlfilter.members(h1, h2, [first, *upper]) == listed).all()
    assert (urlfilter.members(h1, h2, [first]) != listed).any()          # the levels are needed
