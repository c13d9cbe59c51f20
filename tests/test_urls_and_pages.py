import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import fetching, html, links, safety, urls
from linkloom.plans import catalogue

CASES = {
    "HTTP://User:pw@WWW.Example.COM:80": "http://www.example.com/",
    "https://example.com:443/a/B?x=1&y#frag": "https://example.com/a/B?x=1&y",
    "http://example.com:8080": "http://example.com:8080/",
    "http://h:0/": "http://h/",
    "http://h:00443/?": "http://h:443/",
    "http://h:99999/": None,
    "http://h:abc/": None,
    "http://bücher.de/ü": "http://xn--bcher-kva.de/ü",
    "http://ex.com.?q": "http://ex.com/?q",
    "//x/y": "//x/y",
    "": "/",
}


def host_of(url):
    found = urls.Address.of_host(url)
    return found.host if found else ""


def test_normalisation_in_python_and_in_spark(spark):
    rng = random.Random(2)
    inputs = list(CASES) + ["".join(rng.choice(["http", "://", "a", "B.", ":", "/", "?", "#", "@", "[", "]", "8", "é", " "]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    for url, expected in CASES.items():
        assert urls.normalized(url) == expected, url
    rows = urls.with_normalized(spark.createDataFrame([(u,) for u in inputs], "u string"), {"u": ("n", "h")}).collect()
    for r in rows:
        assert r["n"] == urls.normalized(r["u"]), r["u"]
        if r["n"] is not None:
            assert r["h"] == host_of(r["n"]), r["u"]
            assert urls.normalized(r["n"]) in (r["n"], None) or "[" in r["u"] or ":" in r["h"] or "://" not in r["u"], r["u"]


def test_registrable_domains(spark):
    hosts = {"a.b.example.com": "example.com", "shop.x.co.uk": "x.co.uk", "co.uk": "co.uk", "localhost": "localhost", "": "", "10.0.0.1": "0.1"}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.registrable_domain(F.col("h")).alias("d"), urls.registrable_domain(F.col("h"), guard_ips=True).alias("g")).collect()
    assert {r["h"]: r["d"] for r in rows} == hosts == {h: urls.Address('', h, '', '', '', '').domain for h in hosts}
    assert {r["h"]: r["g"] for r in rows}["10.0.0.1"] == "10.0.0.1"


def test_ignored_and_resolved(spark):
    pairs = [
        ("http://a.com/x/y", "z", "http://a.com/x/z"), ("http://a.com/x/y", "/z?q#f", "http://a.com/z?q"), ("https://a.com", "//B.com", "https://b.com/"),
        ("http://a.com/", "mailto:x@y", None), ("http://a.com/", " #top", None), ("http://a.com/", "", None), ("http://a.com/", None, None),
        ("http://a.com/x/", "../../w", "http://a.com/w"), ("http://a.com/", "HTTPS://C.com:443/ä", "https://c.com/ä"), ("http://a.com/", "foo:bar", None), ("http://a.com/", "JavaScript:void(0)", None),
    ]
    rng = random.Random(5)
    bases = ["http://a.com", "https://A.com/x/y?q", "http://a.com/x/", "ftp://a.com/x", "//a.com/x", "http://[::1]/x", "", "http://ü.de/a//b"]
    parts = ["..", ".", "/", "//", "a", "b.c", "?", "#", "http:", "https:", "HTTP://h", ":", " ", "ü", "[", "mailto:"]
    for _ in range(800):
        base, href = rng.choice(bases), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        pairs.append((base, href, urls.link_target(base, href)))
    frame = spark.createDataFrame(pairs, "base string, href string, expected string")
    for r in urls.with_resolved(frame, "base", "href", "got").collect():
        assert r["got"] == r["expected"] == urls.link_target(r["base"], r["href"] or ""), r


@pytest.mark.parametrize(("rel", "kind"), [(None, "FOLLOW"), ("", "FOLLOW"), ("noopener", "FOLLOW"), ("NoFollow nofollow", "NOFOLLOW"), ("ugc, sponsored", "MULTIPLE_REL_VALUES"), ("x\tSponsored", "SPONSORED")])
def test_rel(spark, rel, kind):
    assert spark.createDataFrame([(rel,)], "r string").select(links.classify_rel(F.col("r"))).head()[0] == kind


PAGE = """<title> A &amp; B</title><p>plain.com</p><A HREF="/one" rel=NOFOLLOW>Hello <b>wor</b>ld</A>
<a href="mailto:x@y">m</a><!-- <a href="/hidden">h</a> --><a href="/pic"><img alt="" src=x><img alt=" Logo "></a>
<a href=/outer>out <a href=/inner>in</a> side</a><a href="https://other.org/x">open"""


def test_page_links(spark):
    pages = spark.createDataFrame([(1, "http://Site.com/dir/", PAGE), (2, None, None)], "id int, url string, html string")
    got = html.page_links(pages, keep=("id",)).orderBy("position").collect()
    assert [(r["resolved_url"], r["anchor_text"], r["image_alt"], r["is_image"], r["link_type"]) for r in got] == [
        ("http://site.com/one", "Hello wor ld", "", False, "NOFOLLOW"),
        ("http://site.com/pic", "", "Logo", True, "FOLLOW"),
        ("http://site.com/inner", "in", "", False, "FOLLOW"),
        ("http://site.com/outer", "out side", "", False, "FOLLOW"),
        ("https://other.org/x", "open", "", False, "FOLLOW"),
    ]
    assert got[0]["title"] == "A & B"


def test_titles_are_those_of_the_sql(spark, tmp_path):
    """A reference that was cut has no semicolon; numbered ones and line ends stay, any kind of space around goes."""
    titles = [
        "to &quot", "a &lt", "&gt", "&quot;q&quot;", "x&amp;&amp", "&am", "&amp;lt;", "&amp;quot", "it&#x27;s &#39", "&eacute; &nbsp;", "\u00a0 b \u3000", "\nc \n", "", "& &&", "&copy",
    ]
    pages = [(k, f"<html><head><title>{t}</title></head><a href='/x?a=1&amp;b'>y &quot</a>") for k, t in enumerate(titles)] + [(-1, None), (-2, "<p>none")]
    spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("http://a.org/")).write.parquet(f"{tmp_path}/pages.parquet")
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(duckdb.execute(catalogue.ORACLES["pages_title"]).fetchall())
    got = sorted(map(tuple, catalogue.QUERIES["pages_title"](spark, str(tmp_path)).collect()))
    assert got == want and (0, "to &quot") in got
    assert html.parse("<title> to &quot</title>")[0] == 'to "'  # the parser itself decodes it, as before


def test_like_ignores_ascii_case_alone(spark):
    frame = spark.createDataFrame([("Éa_B",), ("éaxb",), ("a%b",)], "t string")
    like = lambda p: [r[0] for r in frame.select(links.sql_like(F.col("t"), p)).collect()]
    assert like("%A_b%") == [True, True, True]
    assert like("%é%") == [False, True, False]
    assert like("a\\%b") == [False, False, False]


def test_safety(spark):
    good = ["http://example.org/", "https://8.8.8.8:8080/x"]
    bad = ["ftp://example.org/", "http://LOCALHOST/", "http://127.0.0.1/", "http://10.1.2.3/", "http://[::1]/", "http://169.254.169.254/", "http://100.100.100.200/", "http:///x", "", None]
    rows = spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", safety.is_safe_url(F.col("u")).alias("s")).collect()
    assert [r["u"] for r in rows if r["s"]] == good
    assert safety.admitted("http://a.org/x", lambda h: ["8.8.8.8"])[:3] == ("http", "a.org", 80)
    for url, found in (("http://a.org/x", ["8.8.8.8", "10.0.0.1"]), ("http://a.org/", []), ("http://localhost/", ["8.8.8.8"]), ("http://[::1]/", ["8.8.8.8"]), ("ftp://a.org/", ["8.8.8.8"]), ("http://a.org:99999/", ["8.8.8.8"])):
        with pytest.raises(safety.UnsafeUrl):
            safety.admitted(url, lambda h, found=found: found)
    blocked = ["0.0.0.0", "192.168.0.1", "224.0.0.1", "240.0.0.1", "::", "fe80::1", "ff02::1", "fd00:ec2::254", "100.100.100.200", "::ffff:10.0.0.1"]
    assert all(map(safety.is_blocked_address, blocked))
    assert not any(map(safety.is_blocked_address, ["8.8.8.8", "100.64.0.1", "2606:4700::1111", "example.org", ""]))
    assert safety.is_allowed_upload("X.WARC.gz") and not safety.is_allowed_upload("x.exe")


def test_files_stay_in_their_folder(tmp_path):
    (tmp_path / "secret").write_text("s")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/link").symlink_to(tmp_path / "secret")
    with safety.Folder(str(tmp_path / "in")) as folder:
        assert folder.place("../../etc/passwd") == str(tmp_path / "in/passwd")
        with folder.write("../a.csv") as f:
            f.write(b"x")
        assert (tmp_path / "in/a.csv").read_bytes() == folder.read("a.csv").read() == b"x"
        for name in ("..", "", "a/../..", "link"):
            with pytest.raises((safety.UnsafeUrl, OSError)):
                folder.read(name)
        name, f = folder.write_temporary(".warc")
        f.close()
        assert name.endswith(".warc") and (tmp_path / "in" / name).exists()
        assert folder.remove("a.csv") and not folder.remove("a.csv")
    assert not (tmp_path / "in" / name).exists()


def test_pace_and_pauses():
    now, slept = [100.0], []
    pace = fetching.Pace(overall=5, per_host=1, clock=lambda: now[0], sleep=slept.append)
    assert [round(pace.wait(h), 3) for h in ("a", "b", "a", "c")] == [0, 0.2, 1.0, 1.2] and len(slept) == 3
    assert [fetching.pause(k) for k in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    assert fetching.pause(0, "7") == 7 and fetching.pause(0, "900") == 60 and fetching.pause(1, "soon") == 2
    assert fetching.pause(0, "Thu, 01 Jan 1970 00:00:50 GMT", now=20) == 30 and fetching.pause(0, "Thu, 01 Jan 1970 00:00:50 GMT", now=80) == 0


def test_fetches_with_redirects_retries_and_limits():
    answers = {
        "http://a.org/": [(302, {"Location": "/b"}, [])], "http://a.org/b": [(503, {"Retry-After": "2"}, []), (200, {"Content-Type": "text/html"}, [b"<a>", b"x"])],
        "http://in.org/": [(301, {"location": "http://127.0.0.1/"}, [])], "http://loop.org/": [(302, {"location": "http://loop.org/"}, [])] * 9,
        "http://big.org/": [(200, {}, [b"x" * 90] * 3)], "http://busy.org/": [(429, {}, [])] * 4, "http://a.org/no": [(200, {}, [])],
    }
    asked, slept = [], []

    def send(url, headers):
        asked.append((url, headers["User-Agent"]))
        if not answers.get(url):
            raise OSError("no answer")
        return answers[url].pop(0)

    pace = fetching.Pace(overall=1e9, per_host=1e9, sleep=slept.append)
    fetcher = fetching.Fetcher(send, lambda h: ["8.8.8.8"], "me", lambda site: "User-agent: me\nDisallow: /no\n", pace, most_bytes=200)
    row = fetcher.fetch("http://a.org/")
    assert (row["final_url"], row["status"], row["content_type"], row["body"], row["redirect_chain"], row["error"]) == ("http://a.org/b", 200, "text/html", b"<a>x", ["http://a.org/"], None)
    assert 2 in slept and asked[0] == ("http://a.org/", "me")
    assert [fetcher.fetch(f"http://{u}")["error"] for u in ("in.org/", "loop.org/", "big.org/", "gone.org/", "a.org/no", "localhost/")] == ["blocked", "fetch", "fetch", "fetch", "blocked", "blocked"]
    assert fetcher.fetch("http://busy.org/")["status"] == 429 and slept[-3:] == [1, 2, 4]
    assert fetching.site_of("https://a.org:8/x?y") == "https://a.org:8/robots.txt"


def test_public_suffixes(spark):
    lines = ["// comment", "", "com", "co.uk  // two", "*.ck", "!www.ck", "uk", "kōbe.jp", "jp", "*.sch.uk"]
    rules = urls.suffix_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r[0] for r in rules.collect()} == {"com", "co.uk", "*.ck", "!www.ck", "uk", "xn--kbe-qxa.jp", "jp", "*.sch.uk"}
    wanted = {
        "a.b.com": "b.com", "com": "com", "x.co.uk": "x.co.uk", "y.x.co.uk": "x.co.uk", "co.uk": "co.uk", "a.b.ck": "a.b.ck", "z.a.b.ck": "a.b.ck", "b.ck": "b.ck",
        "www.ck": "www.ck", "a.www.ck": "www.ck", "q.xn--kbe-qxa.jp": "q.xn--kbe-qxa.jp", "w.q.xn--kbe-qxa.jp": "q.xn--kbe-qxa.jp", "a.eton.sch.uk": "a.eton.sch.uk",
        "b.a.eton.sch.uk": "a.eton.sch.uk", "a.b.unknown": "b.unknown", "a.b.com.au": "b.com.au", "": "", "localhost": "localhost",
    }
    frame = spark.createDataFrame([(h,) for h in [*wanted, None]], "host string")
    got = {r["host"]: r["d"] for r in urls.with_registrable(frame, "host", "d", rules).collect()}
    assert got == wanted | {None: None}
    assert urls.with_registrable(frame, "host", "d", rules.limit(0)).where("host = 'a.b.com.au'").head()["d"] == "b.com.au"
