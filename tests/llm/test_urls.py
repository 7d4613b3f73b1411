"""URL rules on odd tables, and the joined index against the one in the plan."""

import re

from folioscope.llm import url_rules

KIND = "page_id long, url string, host string, path string, rule int, verdict string, patterns string, t int, u int"
URLS = [None, "", "no scheme", "://", "http://", "HTTP://Ads.Example.COM/EN/x?utm_source=feed", "http://example.com/en/", "http://www.example.com/en/a#b", "http://x.net/es/ads/", "http://a.b.net/fr", "http://x.org/banner/?cart=1", "http://x.org/a.jpg", "http://y/" + "ads/" * 5000, "http://free-bets.org/", "http://my.free-bets.org/\n", "http://x.org/1?utm_source=q&rss=1", "http://é.org/ads?"]


def judged(frame, **kw):
    return sorted((tuple(r) for r in url_rules.judge_urls(frame, **kw).collect()), key=repr)


def brute(urls):
    out = []
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        host = low(host)
        fits = [(h + p, v) for h, p, v in url_rules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
        hits = sorted(r for r in url_rules.PATTERN_RULES if u is not None and re.search(url_rules.to_regex(r).replace(r"\z", r"\Z"), low(u)))
        method = "block" if any(not r.startswith("@@") for r in hits) and not any(r.startswith("@@") for r in hits) else "allow"
        out.append((i, host, path, rule, verdict or method, " ".join(hits)))
    return sorted(out, key=repr)


def test_odd_tables(spark):
    rows = list(enumerate(URLS)) + [(5, URLS[5]), (None, URLS[8]), (None, None)]
    frame = spark.createDataFrame([(*r, "h", "p", 1, "v", "x", 2, 3) for r in rows], KIND)
    assert judged(frame) == brute(rows)
    assert judged(frame.limit(0)) == []
    assert [r[4] for r in judged(frame, pattern_rules=(), host_rules=())] == ["allow"] * len(rows)


def test_joined_rules(spark, monkeypatch):
    rows = list(enumerate(URLS)) + [(5, URLS[5]), (None, URLS[8]), (None, None)]
    frame = spark.createDataFrame([(*r, "h", "p", 1, "v", "x", 2, 3) for r in rows], KIND).repartition(3)
    rules = (*url_rules.PATTERN_RULES, "*ads*", "/es/*")
    once = judged(frame, pattern_rules=rules)
    monkeypatch.setattr(url_rules, "LITERAL", 0)
    assert judged(frame, pattern_rules=rules) == once
    assert judged(frame.limit(0)) == []
