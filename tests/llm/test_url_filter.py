import re
from itertools import combinations

import pytest

from lodestone.llm import url_filter as uf


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule(host, path):
    fit = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda f: len(f[0]), default=(None, None))


def toks(url):
    if url is None or "://" not in url:
        return frozenset()
    host, path = parts(url)
    m = re.search(r"^[^?#]*\?([^#]*)", url.split("://", 1)[1], re.S)
    t = ["h:" + x for x in host.split(".")] + ["p:" + x for x in re.split("[/.]", re.sub("[A-Z]", lambda x: x[0].lower(), path))] + ["q:" + x.split("=")[0] for x in (m[1] if m else "").split("&")]
    return frozenset(x for x in t if len(x) > 2 and not re.match(r"..[0-9]+$", x))


def brute(urls, support, confidence):
    """All token combinations, counted one by one."""
    said = [(toks(u), rule(*parts(u))[1]) for u in urls]
    n = sum(bool(t) or v is not None for t, v in said)
    every = {x for x in set().union(*(t for t, _ in said)) if sum(x in t for t, _ in said) > uf.MOST * len(said)}
    count, both = {}, {}
    for t, v in said:
        use = sorted(t - every)
        for k in range(1, len(use) + 1):
            for c in combinations(use, k):
                count[c] = count.get(c, 0) + 1
                if v:
                    both[c, v] = both.get((c, v), 0) + 1
    rules = {(c, v): b / count[c] for (c, v), b in both.items() if b / n >= support and b / count[c] >= confidence}
    out = []
    for t, v in said:
        fits = [(-conf, -len(c), 0 if w == "block" else 1, " ".join(c), w) for (c, w), conf in rules.items() if set(c) <= t]
        out.append(v or (min(fits)[-1] if fits else "allow"))
    return out, len(rules)


def test_brute_force(spark):
    import random

    rng = random.Random(8)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.', 'Blog.'])}{rng.choice(['a', 'b', 'spam'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(50)}{rng.choice(['', '.html', '?page=2&ref=x', '#top'])}" for _ in range(700)]
    urls += [None, "", "no scheme", "http://", "HTTP://Example.COM", "x://com/?a#b", "x://net/es/", "ftp://EXAMPLE.com/en/\n/é?q", "http://a://b/", "http://wwwexample.com/en/", "http://example.com/enx", "http://x.com" + "/y" * 20_000, urls[0]]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, tokens string").repartition(3)
    got = {r.page_id: r for r in uf.judge(df, support=0.02, confidence=0.4).collect()}
    assert len(got) == len(urls)
    want, n = brute(urls, 0.02, 0.4)
    assert n > 5
    for i, u in enumerate(urls):
        r = got[i]
        assert (r.host, r.path) == parts(u)
        assert r.rule == rule(*parts(u))[0]
        assert r.verdict == want[i], u
    assert any(r.mined and r.verdict == "block" for r in got.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "http://a.org/x")]])
def test_without_labels(spark, rows):
    got = uf.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert [r.verdict for r in got] == ["allow"] * len(rows)


def test_coverage_at_the_settings_of_the_query(spark):
    """Rules of labelled URLs alone, against all combinations counted one by one; tokens that always come together; hosts that only some rules know."""
    import random

    rng = random.Random(3)
    long = "/".join(f"seg{'abcdefghijklmnopqrstuvwx'[i]}" for i in range(24))  # 2^24 subsets
    urls = [f"https://{rng.choice(['shop', 'spam', 'news', 'wiki'])}.example.{rng.choice(['com', 'com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.choice(['', 'a.html', '?page=2&ref=x'])}" for _ in range(900)]
    urls += [f"https://bad.example.com/en/{long}"] * 30 + [f"https://bad.example.org/en/{long}"] * 20
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in uf.judge(df, coverage=uf.COVERAGE).collect()}
    said = [(toks(u), rule(*parts(u))[1]) for u in urls]
    n = len(said)
    every = {x for x in set().union(*(t for t, _ in said)) if sum(x in t for t, _ in said) > uf.MOST * n}
    short = frozenset(x for x in toks(urls[-1]) if x.startswith("p:seg"))
    one = lambda t: frozenset(t - every - short) | ({"LONG"} if short <= t else set())
    count, known, both = {}, {}, {}
    for t, v in said:
        use = sorted(one(t))
        for k in range(1, len(use) + 1):
            for c in combinations(use, k):
                count[c] = count.get(c, 0) + 1
                if v:
                    known[c] = known.get(c, 0) + 1
                    both[c, v] = both.get((c, v), 0) + 1
    rules = {(c, v): b / known[c] for (c, v), b in both.items() if b / n >= uf.SUPPORT and b / known[c] >= uf.CONFIDENCE and known[c] / count[c] >= uf.COVERAGE}
    by_rule = 0
    for i, (t, v) in enumerate(said):
        wide = lambda c: sorted(set(c) - {"LONG"} | (short if "LONG" in c else set()))
        fits = [(-conf, -len(wide(c)), 0 if w == "block" else 1, " ".join(wide(c)), w) for (c, w), conf in rules.items() if set(c) <= one(t)]
        assert got[i].verdict == (v or (min(fits)[-1] if fits else "allow")), urls[i]
        by_rule += v is None and bool(fits)
        assert (got[i].mined is not None) == (v is None and bool(fits))
    assert by_rule >= 20 and got[n - 1].verdict == "block"
