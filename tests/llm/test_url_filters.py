"""The automaton against direct matching."""

import re
import time

from hypothesis import given, settings, strategies as st

from waytrace.llm import url_filters as uf

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7a?q#f", "http://www.example.com/en/8", "http://example.org/x.com/en/", "http://com/en/", "ftp://a.b.net/de/1", "http://example.net/de/8",
    "http://notexample.net/de/8", "http://spam-farm.example.org/", "http://x/wp-login.php", "http://x/wp-login.phpx", "http://a.cheap-pills.b", "http://example.com:80/en/7", "http://É.org/es/é\n?x", "a://b://c.com/en/",
]


def direct(url, rules, globs):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
    hits = [g for g in globs if _glob(g, host, path)]
    return host, path, best.name if best else None, best.action if best else "block" if hits else "allow", hits[0] if hits else None


def _glob(glob, host, path):
    h, slash, p = glob.partition("/")
    spell = lambda g, any_: "".join(any_ + "*" if c == "*" else any_ if c == "?" else re.escape(c) for c in g)
    return bool(re.fullmatch(spell(h, "[\\s\\S]"), host)) and (not slash or bool(re.fullmatch(spell(slash + p, "[\\s\\S]"), path)))


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, host string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in uf.judge_urls(pages).collect()}
    assert got == {i: direct(u, uf.RULES, uf.GLOBS) for i, u in enumerate(URLS + URLS[4:6])}
    assert uf.judge_urls(pages.limit(0)).count() == 0
    (row,) = uf.judge_urls(spark.createDataFrame([(None, "http://ads.x.org/a")], "page_id long, url string")).collect()
    assert (row.page_id, row.verdict, row.glob) == (None, "block", "ads.*")


@settings(max_examples=200, deadline=None)
@given(st.text("ab.-", max_size=8), st.text("/ab?", max_size=6).map(lambda p: "/" + p.replace("?", "")), st.lists(st.tuples(st.text("ab*?.", max_size=6), st.text("ab*/", max_size=4)), min_size=1, max_size=30))
def test_globs(host, path, globs):
    spelled = [h + ("/" + p if p else "") for h, p in globs]
    machine = uf.Automaton([uf.glob_pattern(g) for g in spelled], [None] * len(spelled))
    found = machine.match([b"." + host.encode() + b"\xff" + path.encode()])
    assert sorted(found) == [(0, i) for i, g in enumerate(spelled) if _glob(g, host, path)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "ab", ""]), max_size=4), st.sampled_from(["/", "/a", "/ab", ""])), min_size=1, max_size=40), st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "ab", ""]), min_size=1, max_size=4), st.sampled_from(["", "/", "/a", "/abb"])), max_size=20))
def test_host_rules(rules, urls):
    held = [uf.HostRule("block", ".".join(h), p) for h, p in rules]
    machine = uf.Automaton([uf.host_pattern(r) for r in held] + [uf.glob_pattern("a*b")], [uf.ending_of(r) for r in held] + [None])
    keys = [(".".join(h), p) for h, p in urls]
    found = machine.match([b"." + h.encode() + b"\xff" + p.encode() for h, p in keys])
    fits = [(i, j) for i, (h, p) in enumerate(keys) for j, r in enumerate(held) if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
    fits += [(i, len(held)) for i, (h, p) in enumerate(keys) if _glob("a*b", h, p)]
    assert sorted(found) == sorted(fits)


def test_thousands_of_rules_cost_little():
    rules = [uf.HostRule("block", f"sub{i % 7}.site{i}.example{i % 40}.com", f"/path/{i}") for i in range(2500)] + [uf.HostRule("allow", f"site{i}.net", "/") for i in range(2500)]
    machine = uf.Automaton([uf.host_pattern(r) for r in rules] + [uf.glob_pattern(g) for g in uf.GLOBS], [uf.ending_of(r) for r in rules] + [None] * len(uf.GLOBS))
    keys = [f".www.site{i * 13 % 4000}.{'net' if i % 2 else 'org'}".encode() + b"\xff" + f"/some/longer/path/of/a/page/{i}".encode() for i in range(8192)]
    begin = time.perf_counter()
    found = machine.match(keys)
    assert time.perf_counter() - begin < 8192 * 1e-4 * 3  # 0.1 ms a URL, on a machine up to three times slower
    assert {(i, 2500 + i * 13 % 4000) for i in range(1, 8192, 2) if i * 13 % 4000 < 2500} == set(found)


def test_many_rules_of_one_length(spark):
    rules = [uf.HostRule("block" if i % 2 else "allow", f"h{i}.com", f"/p{i}") for i in range(150)]
    pages = spark.createDataFrame([(i, f"http://x.h{i}.com/p{i}/q") for i in range(150)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge_urls(pages, rules, []).collect()}
    assert got == {i: (f"h{i}.com/p{i}", "block" if i % 2 else "allow") for i in range(150)}


def test_long_url():
    machine = uf.Automaton([uf.glob_pattern("*b/*c")], [None])
    assert machine.match([b".ab\xff/" + b"x" * 50_000 + b"c", b".ab\xff/" + b"x" * 50_000]) == [(0, 0)]


def test_globs_as_sql():
    import duckdb

    con = duckdb.connect()
    for url in [*URLS, "http://ads.a/x", "http://a/cgi-bin/x", "http://a_b.casino-x/", "http://mirror7/pub/x", "http://m/calendar/1/2/3/print"]:
        host, path, *_ = direct(url, [], [])
        for glob, (fit, name) in zip(uf.GLOBS, uf._GLOB_FITS, strict=True):
            assert name == glob
            assert con.execute(f"SELECT {fit} FROM (SELECT ? AS host, ? AS path)", [host, path]).fetchone()[0] == _glob(glob, host, path)
