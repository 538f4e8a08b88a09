import math
import re
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from tidemark.llm import urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(r), -k, v, r) for k, (v, r) in enumerate(urls.RULES) for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[2:] if fits else (None, None)


ODD = ["http://A.example.COM/en/7?x", "ftp://example.com/en/8", "x.com/en/", None, "", "https://net/de/", "http://b.example.net/de/8#q", "http://notcom/en/", "http://org?/es/", "http://", "http:///en/", "http://com/EN/", "a://b://c/d", "http://" + "q" * 3000 + ".org/es/", "http://xn--ñ.com/en/ü"]


def made(spark):
    rows = [(k, u, f"<p>cheap pills {k}</p>" if k % 2 else None, "clash") for k, u in enumerate(ODD)] + [(0, ODD[0], "x", "clash")]
    rows += [(100 + k, f"http://{h}.test/{p}", "<b>red</b> blue pills cheap", "clash") for k, (h, p) in enumerate(product(["cheappills", "bluered", "www.red-pills"], ["a/1", "red"]))]
    rows += [(150 + k, f"http://{h}/{p}/{k}", "<b>red</b> cheap", "clash") for k, (h, p) in enumerate(product(["cheap.pills.com", "redpills.com"], ["en/cheap", "en/buy"]))]
    rows += [(170 + k, f"http://{h}/de/{p}/{k}", "blue", "clash") for k, (h, p) in enumerate(product(["blue.net", "calm.blue.net"], ["sky", "red"]))]
    rows += [(200 + k, f"http://bluered.test/a/{k}", None, "clash") for k in range(12)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_parsing_and_rules(spark):
    df = made(spark)
    got = urls.judge(df).collect()
    assert len(got) == df.count()
    by = {r.page_id: r for r in got}
    for r in df.collect():
        g, (host, path) = by[r.page_id], parse(r.url)
        verdict, rule = rule_of(host, path)
        assert (g.host, g.path, g.rule) == (host, path, rule), r.url
        assert g.verdict == verdict if rule else g.verdict in ("allow", "block")
    assert by[2].verdict == by[3].verdict == "allow"
    # cheap and pills are in hosts that rules block, blue in those that they allow
    assert by[100].score > by[102].score


def test_of_equal_rules_the_first_wins(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    for one, two in (("allow", "block"), ("block", "allow")):
        assert urls.judge(df, rules=[(one, "a.com/x"), (two, "a.com/x")]).first().verdict == one
    assert urls.judge(df, rules=[]).first().verdict == "allow"


def test_viterbi_is_optimal():
    counts = {"the": 50, "there": 9, "re": 20, "in": 40, "rein": 1, "t": 2, "he": 30}
    total = sum(counts.values())
    for name in ("therein", "thein", "zthe", "x"):
        known = {(i, n): counts[name[i : i + n]] for i in range(len(name)) for n in range(1, 9) if name[i : i + n] in counts}
        cost = lambda w: math.log(counts[w] / total) if w in counts else -math.log(total) - len(w) * math.log(10)
        splits = [[p for p in re.split("-", "".join(c + ("-" if b else "") for c, b in zip(name, bits)))] for bits in product([0, 1], repeat=len(name) - 1) for bits in [(*bits, 0)]]
        assert abs(sum(map(cost, urls.viterbi(name, known, total))) - max(sum(map(cost, s)) for s in splits)) < 1e-9


def test_bayes_matches_brute_force(spark):
    df = made(spark)
    counts = Counter()
    for r in df.collect():
        counts.update(w for w in re.findall(r"[a-z]+", re.sub(r"<[^>]*>", " ", (r.html or "").lower())) if len(w) <= urls.LONGEST_WORD)
    total = sum(counts.values())

    def tokens(host, path):
        out = []
        for name in re.findall("[a-z]+", host):
            out += urls.viterbi(name, {(i, n): counts[name[i : i + n]] for i in range(len(name)) for n in range(1, urls.LONGEST_WORD + 1) if i + n <= len(name) and name[i : i + n] in counts}, total)
        path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in path)
        return out + re.sub(r"[^a-z#]+", " ", re.sub("[0-9]+", " # ", path)).split()

    pages = [(r.page_id, tokens(*parse(r.url)), parse(r.url)) for r in df.collect()]
    seen = {True: Counter(), False: Counter()}
    n = Counter()
    for _, t, where in pages:
        if rule_of(*where)[0] is None:
            continue
        bad = rule_of(*where)[0] == "block"
        seen[bad].update(t)
        n[bad] += 1
    size = len(set(seen[True]) | set(seen[False])) + 1
    learned = set(seen[True]) | set(seen[False])
    odds = lambda x: x in learned and math.log((seen[True][x] + 1) / (sum(seen[True].values()) + size)) - math.log((seen[False][x] + 1) / (sum(seen[False].values()) + size))
    got = {r.page_id: r.score for r in urls.judge(df).collect()}
    for k, t, where in pages:
        z = math.log((n[True] + 1) / (n[False] + 1)) + sum(map(odds, t))
        assert abs(got[k] - (0 if where == ("", "") else 1 / (1 + math.exp(-z)))) < 1e-9


def test_empty(spark):
    assert urls.judge(made(spark).limit(0)).count() == 0
