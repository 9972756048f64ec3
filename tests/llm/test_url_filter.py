"""Parts and rules against plain Python, held-out verdicts of the trees."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frostline.llm import url_filter
from frostline.llm.url_filter import ALLOW, BLOCK, Rule

LOW = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return rest[:end].translate(LOW), path[:stop]


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else None


def random_urls(seed, count):
    rng, out = random.Random(seed), [None, "", "://", "http://", "http:///x", "a.net/en/", "http://net", "http://NET/", "http://x.org?q=/fr/"]
    out += ["http://user@Example.NET:80/en/x", "http://a.example.net/en/?u=http://b.org/fr/", "x://y://net/", "http://.net/", "http://É.net/En/"]
    out += ["http://a.net/" + "verzeichnis/" * 5000 + "?" + "x=1&" * 5000, "http://a.net\n/en/", "http://😀.org/fr/"]
    for _ in range(count):
        host = ".".join(rng.choice(["m", "www", "xexample", "example", "Net", "net", "org", "com", ""]) for _ in range(rng.randint(1, 4)))
        path = "".join("/" + rng.choice(["en", "de", "fr", "FR", "7.html", ""]) for _ in range(rng.randint(0, 3)))
        out.append(rng.choice(["http://", "https://", "HTTPS://", "", "//"]) + host + path + rng.choice(["", "?page=2&ref=x", "#top", "?a;b#c?d"]))
    return out


def test_parts_and_rules(spark):
    urls = random_urls(1, 800)
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = [*url_filter.RULES, Rule(ALLOW, "www.example.org", "/"), Rule(BLOCK, "www.example.org", "/en/7"), Rule(ALLOW, "com", "/de")]
    for rules in (url_filter.RULES, more, []):
        for r in url_filter.judged_by_rules(frame, rules).collect():
            host, path = parts(urls[r["page_id"]])
            assert (r["host"], r["path"]) == (host, path)
            assert (tuple(r["rule"]) if r["rule"] else None) == rule_of(host, path, rules)


def test_of_equal_rules_the_block_wins(spark):
    frame = spark.createDataFrame([("http://a.net/x",)], "url string")
    for rules in ([Rule(ALLOW, "net", "/"), Rule(BLOCK, "net", "/")], [Rule(BLOCK, "net", "/"), Rule(ALLOW, "net", "/")]):
        assert tuple(url_filter.judged_by_rules(frame, rules).first()["rule"]) == ("net/", BLOCK)


def test_features(spark):
    urls = [u for u in random_urls(2, 200) if u]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.described(url_filter.judged_by_rules(frame, [])).collect():
        url, (host, path) = urls[r["page_id"]], parts(urls[r["page_id"]])
        labels = [x for x in host.split(".") if x]
        folders = [x for x in path.split("/") if x]
        bits = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
        assert r["entropy"] == pytest.approx(bits)
        assert (r["labels"], r["depth"], r["url_length"]) == (len(labels), len(folders), len(url))
        assert r["digits"] == pytest.approx(sum(c in "0123456789" for c in url) / len(url))
        assert (r["top"], r["registered"]) == ((labels or [""])[-1], ".".join(labels[-2:]))
        assert r["folder"] == (folders or [""])[0] and r["place"] == f"{r['top']}/{r['folder']}"


def planted(seed, count):
    """Bad ones: a bad suffix, or many parameters and digits."""
    rng, rows = random.Random(seed), []
    for k in range(count):
        top = rng.choice(["com", "org", "top", "zip"])
        noisy = rng.random() < 0.3
        name = "".join(rng.choice("abcdefghi") for _ in range(rng.randint(4, 9)))
        url = f"http://{name}.{top}/" + (f"{rng.randrange(10**9)}/{rng.randrange(10**9)}?" + "&".join(f"p{j}={rng.randrange(10**6)}" for j in range(6)) if noisy else f"read/{name}")
        rows.append((k, url, BLOCK if noisy or top == "zip" else ALLOW))
    return rows


def test_held_out_verdicts(spark):
    rows = planted(3, 1500)
    frame = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    held_out = F.col("page_id") % 4 == 0
    model = url_filter.learn(frame.filter(~held_out))
    pages = frame.filter(held_out).withColumnRenamed("verdict", "truth").withColumn("score", F.lit("old")).withColumn("kept", F.lit(1)).withColumn("x", F.lit(2))
    found = url_filter.judge(pages, [], model).collect()
    assert len(found) == 375 and all(r["kept"] == 1 and r["x"] == 2 and r["rule"] is None for r in found)
    assert sum(r["verdict"] == r["truth"] for r in found) / len(found) > 0.97
    # rules come first
    ruled = url_filter.judge(pages, [Rule(ALLOW, "zip", "/")], model).filter("host like '%.zip'").collect()
    assert ruled and all((r["rule"], r["verdict"]) == ("zip/", ALLOW) for r in ruled)


def test_hot_urls_do_not_fill_the_sample(spark):
    rows = planted(5, 400) + [(k, "http://hot.top/read/hot", ALLOW) for k in range(3000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, verdict string").select("url", "verdict")
    model = url_filter.learn(frame, train_urls=300)
    total = sum(n for _, n in model.suffixes["top"].values())
    assert 50 < total <= 300


def test_nothing_to_learn(spark):
    schema = "page_id long, url string, verdict string"
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "http://a.net/x"), (3, "x"), (3, "x")], "page_id long, url string")
    for rows, open_verdict in (([], ALLOW), ([(1, None, BLOCK), (2, "http://a", None)], ALLOW), ([(1, "http://a", BLOCK)], BLOCK), ([(1, "http://a", ALLOW)], ALLOW)):
        model = url_filter.learn(spark.createDataFrame(rows, schema))
        found = url_filter.judge(pages, url_filter.RULES, model).collect()
        assert [r["verdict"] for r in sorted(found, key=lambda r: r["url"] or "")] == [open_verdict, open_verdict, BLOCK, open_verdict, open_verdict]
        assert url_filter.judge(pages.limit(0), url_filter.RULES, model).count() == 0


def test_the_query_learns_from_its_rules(spark, sf_dir):
    """Of the urls that rules judge, those left out of training."""
    pages = spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.1/pages.parquet").select("page_id", "url")
    judged = url_filter.judged_by_rules(pages, url_filter.RULES).select("page_id", "url", F.col("rule.verdict").alias("verdict"))
    known = judged.filter("verdict is not null")
    model = url_filter.learn(known.filter("page_id % 3 <> 0").select("url", "verdict"))
    found = url_filter.judge(known.filter("page_id % 3 = 0").withColumnRenamed("verdict", "truth"), [], model).collect()
    assert sum(r["verdict"] == r["truth"] for r in found) / len(found) > 0.9
