import random
import re

import pytest

from strataloom.llm.url_filter import BLOCKED_LABELS, RULES, url_filter


def brute(urls, rules, labels, listed=()):
    out = []
    for page, url in urls:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = None
        for r in rules:
            h, p = r[: r.index("/")], r[r.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r) > len(best)):
                best = r
        own = host.split(".")
        above = {".".join(own[i:]) for i in range(len(own))} if host else set()
        verdict = rules[best] if best else "block" if above & set(listed) or any(d.split(".")[0] in labels for d in above) else "allow"
        out.append((page, host, path, best, verdict))
    return out


@pytest.mark.parametrize("most_bits", [1 << 23, 64])
def test_same_as_brute_force(spark, most_bits):
    rng = random.Random(1)
    hosts = ["Example.NET", "www.example.net", "a.b.example.com", "example.com", "x.org", "org", "net", "notexample.net", "casino-win.example.org", "m.Spam-Farm.example.org", "bad.test", "x.bad.test", "Ünï.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/de/", "/de/2#top", "/fr/3.html", "/deep/en/", "?q=1", "#f"]
    urls = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(400)] + [(900, None), (901, ""), (902, "no scheme/en/"), (903, "a://b://net/en/"), (903, "a://b://net/en/")]
    frame = spark.createDataFrame([(*u, "x") for u in urls], "page_id long, url string, host string").repartition(3)
    listed = spark.createDataFrame([("bad.test",), ("BAD.test",), (None,)] + [(f"h{i}.test",) for i in range(200)], "domain string")
    got = url_filter(frame, RULES, listed, BLOCKED_LABELS, most_bits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(urls, RULES, BLOCKED_LABELS, ["bad.test"])))


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(frame, RULES).count() == 0
