import pytest

from flowguard.llm import url_filter as u


def brute_rule(host, path):
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


PAGES = [
    (1, "http://Www.Example.COM/en/x?y", None),
    (2, "https://example.com/en/", ""),
    (3, "https://a.net/es/q#z", '<a href="http://b.org/x">b</a><img SRC = \'https://C.org:80/i\'>'),
    (4, "https://a.net/fr/", '<a href="http://b.org/x">'),
    (5, "https://b.org/", '<a href="https://a.net/">'),
    (6, "https://good.com/x", '<a href="https://d.org/">'),
    (7, "https://d.org", ""),
    (8, "nothing", '<a href="https://d.org/">'),
    (9, None, None),
    (10, "://", ""),
    (11, "x://?a://b", ""),
    (12, "http://good.com", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES + PAGES[:2]], "page_id long, url string, html string, found_host int")


def test_hosts_paths_and_rules(pages):
    rows = u.mark(pages, "found").collect()
    assert len(rows) == len(PAGES) + 2
    for r in rows:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        rule = brute_rule(host, path)
        assert (r.found.host, r.found.path, r.found.rule) == (host, path, rule.name if rule else None)
        assert r.found_host == 1
        if rule:
            assert r.found.verdict == rule.verdict


def test_scores_equal_brute_force(pages):
    edges = {}

    def add(a, b, n=1):
        if a != b:
            edges[a, b] = edges.get((a, b), 0) + n

    rows = PAGES + PAGES[:2]
    host = {r[0]: (r[1].split("://", 1)[1].split("/")[0].split("?")[0].lower() if r[1] and "://" in r[1] else "") for r in rows}
    for a, b in (("a.net", "b.org"), ("a.net", "c.org:80"), ("a.net", "b.org"), ("b.org", "a.net"), ("good.com", "d.org")):
        add(a, b)
    for r in rows:
        if host[r[0]].count(".") >= 2:
            parent = host[r[0]].split(".", 1)[1]
            add(host[r[0]], parent)
            add(parent, host[r[0]])
    seeds = {"trust": {}, "distrust": {}}
    for r in rows:
        h = host[r[0]]
        path = r[1].split("://", 1)[1][len(h) :].split("?")[0].split("#")[0] if h else ""
        rule = brute_rule(h, path)
        if rule:
            side = seeds["trust" if rule.verdict == "allow" else "distrust"]
            side[h] = side.get(h, 0) + 1
    got = {r.host: (r.trust, r.distrust) for r in u.judge_hosts(pages).collect()}
    for k, side in enumerate(("trust", "distrust")):
        all_ = sum(seeds[side].values())
        seed = {h: n * u.MASS // all_ for h, n in seeds[side].items()}
        graph = {((b, a) if k else (a, b)): n for (a, b), n in edges.items()}
        total = {}
        for (a, _), n in graph.items():
            total[a] = total.get(a, 0) + n
        mass = dict(seed)
        for _ in range(u.ROUNDS):
            new = {h: (100 - u.FOLLOW) * m for h, m in seed.items()}
            for (a, b), n in graph.items():
                if a in mass:
                    new[b] = new.get(b, 0) + u.FOLLOW * (mass[a] // total[a] * n + mass[a] % total[a] * n // total[a])
            mass = {h: m // 100 for h, m in new.items()}
        assert {h: v[k] for h, v in got.items() if v[k]} == {h: m for h, m in mass.items() if m}


def test_linking_to_blocked_hosts_is_punished(pages):
    verdict = {r.host: r.verdict for r in u.judge_hosts(pages).collect()}
    assert verdict["b.org"] == "block" and verdict["d.org"] == "allow"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert u.mark(empty, "found").count() == 0
