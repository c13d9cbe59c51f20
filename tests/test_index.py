import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from linkloom import cli, logs
from linkloom.functions import robots, urls
from linkloom.operators import build, merge, stats, verify
from linkloom.operators.search import Search, Target, matches_link, total_pages
from linkloom.plans import catalogue, feed
from linkloom.schema import INDEX
from linkloom.sources import crawl, files, records, sinks, stored, warc
from linkloom.streaming import ingest, jobs

NOW, LATER = "2024-01-01T00:00:00+00:00", "2024-02-01T00:00:00+00:00"


def rows(spark, data, as_of=NOW, **more):
    feed = spark.createDataFrame([(k, *d) for k, d in enumerate(data)], "id long, source_url string, target_url string, anchor_text string, rel string")
    return build.build_links(feed, as_of, arrival=F.col("id"), **more)


def _nodes(node):
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def test_the_fold_shuffles_no_derived_columns(spark):
    """Domains and evidence follow from what is shuffled, and methods too large to be compiled are not made."""
    plan = merge.upsert(None, rows(spark, DATA))._jdf.queryExecution().optimizedPlan()
    dealt = [n for n in _nodes(plan) if n.nodeName() == "RepartitionByExpression"]
    names = {dealt[0].output().apply(k).name() for k in range(dealt[0].output().size())}
    assert len(dealt) == 1 and {"normalized_source_url", "source_hostname", "anchor_text"} <= names
    assert not names & {"normalized_target_domain", "source_domain", "target_hostname", "evidence_hash"}
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


DATA = [
    ("http://a.com/1", "https://www.T.com:443/x#f", "one", ""), ("http://a.com/1", "https://www.t.com/x", "two", ""), ("http://b.org/", "http://t.com/docs/a_b", "", "nofollow"),
    ("http://b.org/2", "http://nott.com/", "three", "ugc"), ("http://b.org/3", "http://h:99999/", "bad", ""), ("", "http://t.com/", "none", ""), ("http://c.co.uk/", "http://t.com.evil.org/?u=t.com", "look", "noopener"),
]


def test_build_and_upsert(spark):
    batch = rows(spark, DATA)
    got = {(r["source_url"], r["anchor_text"]): r for r in batch.collect()}
    assert len(got) == 5
    first = got[("http://a.com/1", "one")]
    assert (first["normalized_target_domain"], first["normalized_target_hostname"], first["link_type"]) == ("t.com", "www.t.com", "UNKNOWN")
    assert got[("http://c.co.uk/", "look")]["normalized_target_domain"] == "evil.org"
    index = merge.upsert(None, batch)
    assert index.count() == 4
    counts = merge.insert_counts(index, rows(spark, DATA[2:4], LATER)).head()
    assert tuple(counts) == (0, 2)
    newer = rows(spark, [("http://b.org/", "http://t.com/docs/a_b", "changed", "nofollow"), ("http://n.com/", "http://t.com/", "new", "")], LATER, status="REMOVED")
    newer = newer.withColumns({"source_http_status": F.lit(None).cast("int"), "evidence_hash": F.lit("")})
    both = merge.upsert(index.withColumn("source_http_status", F.lit(200)), newer)
    old = both.where("source_url = 'http://b.org/'").head()
    assert (old["anchor_text"], old["last_seen_at"], old["first_discovered_at"], old["verification_status"], old["source_http_status"]) == ("", LATER, NOW, "REMOVED", 200)
    assert old["evidence_hash"] != ""
    assert both.count() == 5 and merge.integrity(both).head() == (0, 0, 0)
    again = merge.upsert(both, newer)
    assert sorted(map(tuple, again.drop("updated_at").collect()), key=str) == sorted(map(tuple, both.drop("updated_at").collect()), key=str)
    assert merge.delete_collection(both.withColumn("collection", F.lit("x")), "x").count() == 0


def test_rows_are_folded_behind_the_shuffle(spark):
    """No task sorts whole rows before the shuffle, evidence is not part of it, and filters of hosts and domains pass below it."""
    index = merge.upsert(None, rows(spark, DATA))
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    plan = index.where("source_domain = 'a.com'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    below = plan[plan.index("Exchange hashpartitioning(normalized_source_url") :]
    assert "Aggregate" not in below and "sha2" not in below and "Filter" in below and "sha2" in plan
    last = {r["evidence_hash"] for r in rows(spark, DATA).collect()}
    assert {r["evidence_hash"] for r in index.collect()} <= last


def test_tasks_of_the_fold_grow_with_its_rows(spark, monkeypatch):
    """However few partitions the session asks for, a task sorts no more rows; beyond what Spark deals without gathering it stays at that."""
    assert merge.tasks_for(spark, 0) is merge.tasks_for(spark, 4 * merge.TASK_ROWS) is None
    assert merge.tasks_for(spark, 9 * merge.TASK_ROWS + 1) == 10 and merge.tasks_for(spark, 10**9) == merge.TASKS
    small = "/root/testdata/sf0.001"
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan()
    assert [n.optNumPartitions().isDefined() for n in _nodes(plan(feed.index(spark, small))) if n.nodeName() == "RepartitionByExpression"] == [False]
    whole = same(feed.index(spark, small))
    monkeypatch.setattr(merge, "TASK_ROWS", 500)
    index, n = feed.index(spark, small), -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 500)
    assert [x.optNumPartitions().get() for x in _nodes(plan(index)) if x.nodeName() == "RepartitionByExpression"] == [n]
    assert same(index) == whole
    for own in ("150", "1000"):  # sessions with more
        spark.conf.set("spark.sql.shuffle.partitions", own)
        found = [merge.tasks_for(spark, k * 500) for k in (2, 120, 1000)]
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert found == ([None, None, 200] if own == "150" else [None, 120, 200])


@pytest.mark.parametrize("placed", [True, False])
def test_rows_go_through_the_shuffle_without_their_order(spark, placed):
    """What tells rows apart follows from their columns and is reckoned behind the shuffle; columns of the most different lengths go last,
    so that the places of all others are the same from row to row. Who is first and last stays as it was."""
    plan = merge.fold(rows(spark, DATA), F.col("id"), placed)._jdf.queryExecution().optimizedPlan()
    dealt = next(n for n in _nodes(plan) if n.nodeName() == "RepartitionByExpression").output()
    names = [dealt.apply(k).name() for k in range(dealt.size())]
    assert not {"_o", "_h"} & set(names)
    last = [c for c in merge.VARIED if c in names]  # without columns of one value, which are not shuffled
    assert names[-len(last) :] == last and {"source_hostname", "anchor_text", "target_url"} <= set(last)
    tied = rows(spark, DATA).withColumn("id", F.lit(7).cast("long"))
    whole = [f.name for f in INDEX if not placed or f.name not in ("target_hostname", "normalized_target_domain", "source_domain", "evidence_hash")]
    least = {r["k"]: r["a"] for r in tied.groupBy(F.struct(*merge.KEY).alias("k")).agg(F.min_by("anchor_text", F.xxhash64(*whole)).alias("a")).collect()}
    found = {tuple(r[c] for c in merge.KEY): r["anchor_text"] for r in merge.fold(tied, F.col("id"), placed).collect()}
    assert found == {tuple(k): a for k, a in least.items()} and len(found) == 4


@pytest.mark.parametrize("query", ["filter_status", "filter_not_live"])
def test_filters_of_folded_values_take_one_narrow_shuffle(spark, query):
    """What the last row says is asked behind the fold, whose one shuffle has no column that follows from others."""
    plan = catalogue.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    dealt = [n.output() for n in _nodes(plan) if n.nodeName() == "RepartitionByExpression"]
    names = [dealt[0].apply(k).name() for k in range(dealt[0].size())]
    assert len(dealt) == 1 and not {"_o", "_h", "_order", "evidence_hash", "source_domain"} & set(names)
    assert names[-len(merge.VARIED) :] == list(merge.VARIED)


def test_applied_results_fold_the_index_once(spark):
    """Results of ids that the index lacks are left out, and the tasks that join do not change what comes out."""
    query = catalogue.QUERIES["apply_verification"](spark, "/root/testdata/sf0.001")
    found = [n for n in _nodes(query._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert sum("normalized_source_url" in n.partitionExpressions().toString() for n in found) == 1
    index = merge.upsert(None, rows(spark, DATA))
    results = spark.createDataFrame([(0, "REMOVED", 410), (99, "REMOVED", 410)], "id long, verification_status string, source_http_status int")
    results = results.selectExpr("*", "'text/html' AS content_type", "0 AS live_backlink_present", "'[]' AS redirect_chain", "'' AS evidence_hash", "'c' AS last_checked_at")
    plain, dealt = (same(verify.apply_verification(index, results, LATER, tasks)) for tasks in (None, 7))
    assert plain == dealt and len(plain) == 4
    changed = verify.apply_verification(index, results, LATER, 7).where("verification_status = 'REMOVED'").collect()
    assert [(r["id"], r["source_http_status"], r["updated_at"]) for r in changed] == [(0, 410, LATER)]
    plan = verify.apply_verification(index, results, LATER, 7)._jdf.queryExecution().optimizedPlan()
    assert [n.optNumPartitions().get() for n in _nodes(plan) if n.nodeName() == "RepartitionByExpression" and n.partitionExpressions().toString().startswith("List(id")] == [7, 7]


def test_search(spark):
    index = merge.upsert(None, rows(spark, DATA)).persist()
    find = lambda **o: sorted(r["source_url"] for r in Search(**o).rows(index).collect())
    assert find(target="http://T.com/anything") == ["http://a.com/1", "http://b.org/"]
    assert find(target="www.t.com", mode="exact_hostname") == ["http://a.com/1"]
    assert find(target="https://www.t.com/x", mode="exact_url") == ["http://a.com/1"]
    assert find(target="t.com/DOCS/axb", mode="path_prefix") == []
    assert find(target="t.com/docs/a_b", mode="path_prefix") == ["http://b.org/"]
    assert find(link_types=["UGC", "NOFOLLOW"], exclude_blank_anchor=True) == ["http://b.org/2"]
    assert find(unique_source_domain=True) == ["http://a.com/1", "http://b.org/", "http://c.co.uk/"]
    assert find(live_only=False) == find() and find(live_only=True) == []
    assert Search(unique_source_domain=True).count(index).head()[0] == 3
    page = Search(sort_by="source_url", descending=False).page(index, 2, 2).collect()
    assert [r["source_url"] for r in page] == ["http://b.org/2", "http://c.co.uk/"]
    assert total_pages(0, 50) == 1 and total_pages(101, 50) == 3
    assert stats.index_stats(index).head().asDict() == {"backlinks": 4, "source_pages": 4, "source_domains": 3, "target_domains": 3}
    assert Target("Example.co.uk/a/b").domain == "example.co.uk" and Target("Example.co.uk/a/b").prefix == "/a/b" and Target("x.com/").prefix == "/"
    index.unpersist()


def test_exports(spark, tmp_path):
    index = merge.upsert(None, rows(spark, [*DATA, ('http://q.com/"', "http://t.com/é", 'say "hi", you', "")])).persist()
    search = Search(sort_by="source_url", descending=False)
    sinks.export("csv", index, search, f"{tmp_path}/csv")
    text = next(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-")).read_bytes().decode()
    assert text.startswith("source_url,source_domain,source_title,target_url") and ",rel," in text.split("\r\n")[0]
    assert '"say ""hi"", you"' in text and text.count("\r\n") == 6
    told = []
    objects = json.loads(open(sinks.write_json(index, search, f"{tmp_path}/x.json", told.append), encoding="utf-8").read())
    assert len(objects) == 5 and "rel_original" in objects[0] and told == [6]
    assert json.loads(open(sinks.write_json(index.limit(0), search, f"{tmp_path}/y.json")).read()) == []
    sinks.export("referring_domains", index, search, f"{tmp_path}/txt")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/txt").collect()] == ["a.com", "b.org", "c.co.uk", "q.com"]
    sinks.export("source_target_pairs", index, search, f"{tmp_path}/pairs")
    assert spark.read.text(f"{tmp_path}/pairs").count() == 5
    with pytest.raises(ValueError, match="unknown format"):
        sinks.export("xls", index, search, "x")
    assert sinks.format_of("a.TSV") == "tsv" and sinks.format_of("a") == "csv"
    index.unpersist()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿ Source_URL ,TARGET_URL,rel,rel_original,anchor_text,collection\nhttp://a.com/, http://t.com/ ,,nofollow,"x, ""y""",\nhttp://b.com/,http://t.com/,ugc,,,c,extra,cells\n', encoding="utf-8")
    got = files.read_links(spark, f"{tmp_path}/a.csv", "given").orderBy("source_url").collect()
    assert [(r["source_url"], r["target_url"], r["rel"], r["anchor_text"], r["collection"]) for r in got] == [("http://a.com/", "http://t.com/", "", 'x, "y"', ""), ("http://b.com/", "http://t.com/", "ugc", "", "c")]
    lines = ['{"source_url": "http://a.com/", "target_url": "http://t.com/", "rel_original": "ugc", "source_title": null}', "", "[1]", "{broken", "5", '{"source_url": "http://b.com/", "target_url": "x", "collection": ""}']
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    got = files.read_links(spark, f"{tmp_path}/b.jsonl.gz", "given").orderBy("source_url").collect()
    assert [(r["source_url"], r["rel"], r["collection"], r["source_title"]) for r in got] == [("http://a.com/", "ugc", "given", ""), ("http://b.com/", "", "", "")]
    (tmp_path / "c.json").write_text(f"[{lines[0]}, 3, {lines[5]}]")
    assert files.read_links(spark, f"{tmp_path}/c.json").count() == 2
    (tmp_path / "d.json").write_text('{"a": 1}')
    (tmp_path / "e.csv").write_text("foo,bar\n1,2\n")
    for name in ("d.json", "e.csv", "f.xyz", "g.ndjson.gz"):
        with pytest.raises(files.SourceError):
            files.read_links(spark, f"{tmp_path}/{name}")
    spark.createDataFrame([("http://a.com/", 7, "", "ugc", "")], "SOURCE_URL string, target_url int, rel string, rel_original string, collection string").write.parquet(f"{tmp_path}/h.parquet")
    r = files.read_links(spark, f"{tmp_path}/h.parquet", "given").head()
    assert (r["target_url"], r["rel"], r["collection"]) == ("7", "ugc", "given")
    (tmp_path / "l.txt").write_text(" http://a \n\n\thttp://b\n")
    assert [r[0] for r in files.read_lines(spark, f"{tmp_path}/l.txt").collect()] == ["http://a", "http://b"]


def record(kind, uri, payload, content_type="application/http"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def test_archives(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=x\r\n\r\n<title>T</title><a href=/x>go</a>"
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n<a href=/no>"
    parts = [record("warcinfo", "", b"x"), b"junk\r\n", record("response", "http://a.com/", page), record("response", "http://a.com/i", image)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    for name in ("a.warc", "b.warc.gz"):
        got = warc.read_warc(spark, f"{tmp_path}/{name}").collect()
        assert [(r["target_uri"], r["http_status"]) for r in got] == [("http://a.com/", 200), ("http://a.com/i", 200)]
        feed = files.read_links(spark, f"{tmp_path}/{name}", "c").collect()
        assert [(r["target_url"], r["anchor_text"], r["source_title"], r["record_filename"]) for r in feed] == [("http://a.com/x", "go", "T", name)]
    offset = len(gzip.compress(parts[0])) + len(gzip.compress(parts[1]))
    one = warc.read_ranges(spark, [(f"{tmp_path}/b.warc.gz", offset, len(gzip.compress(parts[2])))]).collect()
    assert [r["target_uri"] for r in one] == ["http://a.com/"]
    bad = record("response", "http://b.com/", page.replace(b"go", b"g\xffo")) + record("response", "http://large.com/", b"x" * 5000)
    (tmp_path / "d.warc").write_bytes(b"\0" * 700_000 + b"\n" + bad + record("response", "http://c.com/", page) + record("response", "http://cut.com/", page)[:-40])
    (tmp_path / "e.warc.gz").write_bytes((tmp_path / "b.warc.gz").read_bytes()[:-20])
    assert [r["target_uri"] for r in warc.read_warc(spark, f"{tmp_path}/d.warc", max_record=4000).collect()] == ["http://b.com/", "http://c.com/"]
    damage = warc.read_damage(spark, f"{tmp_path}/[de].warc*", max_record=4000).collect()
    assert sorted((r["filename"], r["target_uri"]) for r in damage) == [("d.warc", "http://cut.com/"), ("d.warc", "http://large.com/"), ("e.warc.gz", None)]
    assert [r["anchor_text"] for r in files.read_links(spark, f"{tmp_path}/d.warc").collect()] == ["g\ufffdo", "go"]
    with pytest.raises(warc.InflatedTooLarge):
        warc.inflate(gzip.compress(b"x" * 100_000), 1000)
    meta = {"Envelope": {"WARC-Header-Metadata": {"WARC-Target-URI": "http://a.com/d/"}, "Payload-Metadata": {"HTTP-Response-Metadata": {"HTML-Metadata": {"Head": {"Title": None}, "Links": [{"url": "e", "text": "t"}, 5, {"path": "x"}, {"href": "//b.org"}]}}}}}
    assert warc.inflate(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"
    (tmp_path / "m.wat").write_bytes(record("metadata", "", json.dumps(meta).encode().replace(b'"t"', b'"t\xff"')))
    assert {r["anchor_text"] for r in files.read_links(spark, f"{tmp_path}/m.wat").collect()} == {"t\ufffd", ""}
    (tmp_path / "c.wat").write_bytes(record("metadata", "", json.dumps(meta).encode()) + record("metadata", "", b"{bad") + record("metadata", "", b"{}"))
    feed = files.read_links(spark, f"{tmp_path}/c.wat").collect()
    assert sorted((r["target_url"], r["anchor_text"]) for r in feed) == [("http://a.com/d/e", "t"), ("http://b.org/", "")]
    (tmp_path / "cdx.jsonl").write_text('{"url":"http://s.a.com/","status":"200","offset":"5","length":"7","filename":"f"}\n{"url":"http://nota.com/","status":"200","offset":"1","length":"1"}\n{"url":"http://a.com/","offset":"x","length":"1"}\nbad\n')
    found = crawl.query_captures(crawl.read_captures(spark, f"{tmp_path}/cdx.jsonl"), "a.com", filters=("status:200",))
    assert [(r["url"], r["offset"]) for r in found.collect()] == [("http://s.a.com/", 5)]


def test_verification(spark):
    body = b'<a href="/x">x</a><a href="http://www.t.com/p">t</a>'
    data = [
        ("http://a/", "http://a/", 200, "text/html", body, None, None), ("http://b/", None, 200, "", b"<a href=/t.com>", ["http://b/"], None), ("http://c/", None, 404, "", body, None, None),
        ("http://d/", None, 200, "", None, None, None), ("http://e/", None, None, None, None, None, "fetch"), ("http://f/", None, None, None, None, None, "blocked"),
    ]
    frame = spark.createDataFrame(data, "url string, final_url string, status int, content_type string, body binary, redirect_chain array<string>, error string")
    for had, expected in (
        (True, ["ARCHIVED_CONFIRMED", "REMOVED", "ARCHIVED_ONLY", "ARCHIVED_ONLY", "ARCHIVED_ONLY", "VERIFICATION_FAILED"]),
        (False, ["LIVE_CONFIRMED", "REMOVED", "SOURCE_UNAVAILABLE", "SOURCE_UNAVAILABLE", "SOURCE_UNAVAILABLE", "VERIFICATION_FAILED"]),
    ):
        got = verify.verify(frame, Target("t.com"), F.lit(had)).collect()
        assert [r["verification_status"] for r in got] == expected
        assert [r["live_backlink_present"] for r in got] == [1, 0, None, None, None, None]
        assert [r["evidence_hash"] != "" for r in got] == [True, True, False, False, False, False]
    broken = spark.createDataFrame([(*data[0][:4], b"\xff\xc3" + body, None, None)], frame.schema)
    assert verify.verify(broken, Target("t.com")).head()["verification_status"] == "ARCHIVED_CONFIRMED"
    assert verify.seed_crawl(broken, NOW).count() == 2
    links = verify.seed_crawl(frame, NOW).collect()
    assert {(r["target_url"], r["live_backlink_present"]) for r in links} >= {("http://www.t.com/p", 1)}


def test_frontier_over_all_orders(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = {}
    for c, o in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        out.setdefault(f"u{c % 300}", set()).add(f"u{o * 7 % 400}")
    level, edge = {"u1": 0}, {"u1"}
    for k in range(1, 5):
        edge = {t for s in edge for t in out.get(s, ())} - level.keys()
        level |= dict.fromkeys(edge, k)
    got = catalogue.QUERIES["frontier_bfs"](spark, sf_dir).collect()
    assert len(got) == len(level) > 300 and {r["url"]: r["level"] for r in got} == level


def same(frame):
    return sorted(str(r) for r in frame.drop("id").collect())


def folder_bytes(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_stored_index_in_layers(spark, tmp_path):
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=8)
    assert index.read() is None and index.upsert(rows(spark, [])) == {"inserted": 0, "duplicates": 0}
    assert index.upsert(rows(spark, DATA)) == {"inserted": 4, "duplicates": 1}
    index.compact()
    before = index.manifest()
    plain = merge.upsert(None, rows(spark, DATA))
    assert same(index.read()) == same(plain) and not before["layers"] and len(before["base"]) > 1
    later = rows(spark, [("http://b.org/", "http://t.com/docs/a_b", "changed", "nofollow"), ("http://n.com/", "http://t.com/", "new", "")], LATER)
    assert index.upsert(later) == {"inserted": 1, "duplicates": 1}
    after = index.manifest()
    assert after["base"] == before["base"] and len(after["layers"]) == 1 and after["layers"][0]["rows"] == 2
    whole = merge.upsert(plain, later)
    assert same(index.read()) == same(whole) and merge.integrity(index.read()).head() == (0, 0, 0)
    found = index.search(Search(target="t.com"))
    assert same(found) == same(Search(target="t.com").rows(whole))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(normalized_target_domain,t.com)" in plan and "EqualTo(bucket," in plan
    assert index.search(Search(target="www.t.com", mode="exact_hostname")).count() == 1
    assert index.search(Search(target="https://www.t.com/x", mode="exact_url")).count() == 1
    index.compact()
    compacted = index.manifest()
    assert len([u for u in compacted["base"] if compacted["base"][u] != before["base"].get(u)]) == 1 < len(before["base"])  # one domain, one bucket
    found = index.search(Search(target="t.com"))
    assert same(found) == same(Search(target="t.com").rows(whole)) and len(found.inputFiles()) == 1
    assert index.vacuum(keep=1) == 5 and same(index.read()) == same(whole)  # two layers and their sketches, and the bucket's old files
    (tmp_path / f"index/manifest-{index.version() + 1}.json").write_text(json.dumps(index.manifest() | {"schema": 99}))
    with pytest.raises(ValueError, match="schema version"):
        index.read()


def links_of(numbers, to=7):
    return [(f"http://s{k % 50}.com/{k}", f"http://t{k % to}.com/{k % 11}", f"a{k}", ["", "nofollow"][k % 2]) for k in numbers]


@pytest.mark.parametrize("maintained", [False, True])
def test_layers_read_like_one_fold(spark, tmp_path, monkeypatch, maintained):
    rng = random.Random(3)
    monkeypatch.setattr(stored.StoredIndex, "PART_BYTES", 6000)
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=3)
    data, done = [], set()
    for batch in range(7):
        part = links_of(rng.choices(range(400), k=60))
        as_of = f"2024-0{batch + 1}-01T00:00:00+00:00"
        data.append(rows(spark, part, as_of, status="REMOVED" if batch % 2 else "ARCHIVED_ONLY").withColumn("source_http_status", F.when(F.col("id") % 3 == batch % 3, 200 + batch)))
        written = folder_bytes(tmp_path) if batch else 0
        counts = index.upsert(data[-1])
        alone = data[-1].select(*INDEX.names).repartition(1)
        alone.write.parquet(f"{tmp_path}/alone-{batch}")
        assert folder_bytes(tmp_path / "index") - written <= 2 * folder_bytes(tmp_path / f"alone-{batch}")
        keys = {(s, t, rel) for s, t, _, rel in part}
        assert counts == {"inserted": len(keys - done), "duplicates": 60 - len(keys - done)}
        done |= keys
        if maintained:
            did = index.maintain()
            assert did == "kept" or len(index.manifest()["layers"]) < 4
        for folder in tmp_path.glob("alone-*"):
            for f in folder.rglob("*.parquet"):
                f.write_bytes(b"")
    whole = data[0]
    top = 0
    for k, d in enumerate(data):
        whole = d.withColumn("id", F.col("id") + top) if k == 0 else whole.unionByName(d.withColumn("id", F.col("id") + top))
        top += 1000
    assert same(index.read()) == same(merge.fold(whole, F.col("id")))
    assert index.read().select("id").distinct().count() == len(done)
    domain = index.search(Search(target="t3.com"))
    assert same(domain) == same(merge.fold(whole, F.col("id")).where("normalized_target_domain = 't3.com'"))
    if maintained:
        index.compact()
        assert max(index.manifest()["parts"].values()) > 1 and len(index.manifest()["base"]) > 3 and not index.manifest()["layers"]
        assert same(index.read()) == same(merge.fold(whole, F.col("id")))
    assert index.delete_collection("nothing") == 0

@pytest.mark.parametrize("few_later", [False, True])
def test_few_rows_are_sent_to_many(spark, few_later):
    """Two layers merged by sending one around are their fold, and the other one is not shuffled."""
    first = rows(spark, links_of(range(0, 60))).withColumns({"source_http_status": F.lit(200), "redirect_chain": F.lit("x"), "last_checked_at": F.when(F.col("id") % 2 == 0, NOW)})
    last = rows(spark, links_of([*range(40, 90)], to=7), LATER, status="REMOVED").withColumns({
        "id": F.col("id") + 1000, "source_http_status": F.when(F.col("id") % 3 == 0, 404), "anchor_text": F.lit("other"), "evidence_hash": F.when(F.col("id") % 2 == 0, "e").otherwise("")})
    got = stored.with_few(first, last, few_later)
    assert same(got) == same(merge.fold(first.unionByName(last), F.col("id"))) and got.count() == 90
    nodes = [n.nodeName() for n in _nodes(got._jdf.queryExecution().sparkPlan())]
    assert nodes.count("BroadcastHashJoin") == 3 and not {"SortMergeJoin", "ShuffledHashJoin"} & set(nodes)


def test_records_of_datasets_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """Places need no shuffle of records, a batch of datasets keeps none of them meanwhile, and what is refused is still told."""
    spark.createDataFrame([(f"http://a.org/{k}", f"http://b{k % 3}.org/") for k in range(30)] + [("http://a.org/", "http://h:99999/")], "source_url string, target_url string") \
        .repartition(3).write.options(header=True, compression="gzip").csv(f"{tmp_path}/0.csv")
    read = records.read_records(spark, f"{tmp_path}/0.csv", "", 2, 20)
    nodes = [n.nodeName() for n in _nodes(read._jdf.queryExecution().sparkPlan())]
    assert "BroadcastHashJoin" in nodes and "SortMergeJoin" not in nodes
    held = []
    monkeypatch.setattr(type(read), "persist", lambda rows, *a: held.append(rows) or rows)
    index, log = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=2), jobs.Jobs(f"{tmp_path}/state")
    number = log.create("files", {})
    assert ingest.run_files(spark, log, number, [f"{tmp_path}/0.csv"], index, NOW) == "completed"
    assert index.read().count() == 30 and [r["message"] for r in index.rejected().collect()] == ["an impossible port"] and not held
    only = f"{tmp_path}/1.csv"
    spark.createDataFrame([("http://a.org/", "http://h:99999/")], "source_url string, target_url string").coalesce(1).write.options(header=True).csv(only)
    ingest.run_files(spark, log, log.create("files", {}), [only], index, NOW)  # a batch without a link
    assert index.rejected().count() == 2 and index.read().count() == 30


def test_a_read_of_few_columns_shuffles_these(spark, tmp_path, monkeypatch):
    """Layers of many rows are folded by the columns that are asked for, and their keys are counted by digests."""
    monkeypatch.setattr(stored.StoredIndex, "FEW_ROWS", 10)
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=3)
    first, last = (rows(spark, links_of(k), t) for k, t in ((range(60), NOW), (range(40, 100), LATER)))
    odd = rows(spark, [("http://h.com:8080//y", "//u@T1.com/z", "odd", "")], LATER).withColumn("id", F.col("id") + 500)
    last = last.unionByName(odd)
    assert index.upsert(first, placed=True)["inserted"] == 60 and index.upsert(last, placed=True) == {"inserted": 41, "duplicates": 20}
    whole = merge.fold(first.unionByName(last.withColumn("id", F.col("id") + 60)), F.col("id"))
    assert same(index.read()) == same(whole)
    few = index.read().select("normalized_source_url", "normalized_target_domain", "anchor_text")
    assert sorted(few.collect()) == sorted(whole.select(*few.columns).collect())
    dealt = [n for n in _nodes(few._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    names = {dealt[0].output().apply(k).name() for k in range(dealt[0].output().size())}
    assert len(dealt) == 1 and names == {"id", "normalized_source_url", "normalized_target_url", "link_type", "normalized_target_domain", "anchor_text"}


def test_tasks_of_a_stored_batch_grow_with_its_rows(spark, tmp_path, monkeypatch):
    """Of a batch whose size is known, and of layers that are read, no task folds much more than its share."""
    monkeypatch.setattr(merge, "TASK_ROWS", 10)
    monkeypatch.setattr(stored.StoredIndex, "FEW_ROWS", 10)
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=2)
    for k in range(2):
        index.upsert(rows(spark, links_of(range(k * 200, k * 200 + 200))), placed=True, size=200)
        assert len(list((tmp_path / "index" / index.manifest()["layers"][k]["folder"]).glob("*.parquet"))) > 14
    assert index.read().rdd.getNumPartitions() == 40 and index.read().count() == 400


def test_filled_by_one_shuffle(spark, tmp_path):
    """Rows are written as the fold deals them, so a bucket is in few files and no row is shuffled again."""
    batch = rows(spark, links_of(range(900), to=70))
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=4)
    plan = merge.fold(batch, F.col("id"), True, index._near(4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_bucket") == plan.count("Exchange") == 1
    index.fill(batch)
    assert same(index.read()) == same(merge.upsert(None, batch))
    domain = batch.head()["normalized_target_domain"]
    assert same(index.read(domain)) == same(merge.upsert(None, batch).where(F.col("normalized_target_domain") == domain))
    index.upsert(rows(spark, links_of(range(500, 1200), to=70), LATER), placed=True)
    both = batch.unionByName(rows(spark, links_of(range(500, 1200), to=70), LATER).withColumn("id", F.col("id") + 900))
    assert same(index.read().drop("id")) == same(merge.fold(both, F.col("id")).drop("id"))


def test_counts_without_opening_rows(spark, tmp_path):
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=4)
    assert index.stats() is None
    index.upsert(rows(spark, links_of(range(3000), to=700)))
    index.upsert(rows(spark, links_of(range(2000, 4000), to=700)))
    exact = stats.index_stats(index.read()).head().asDict()

    def close():
        got = index.stats()
        return got["backlinks"] == exact["backlinks"] and all(abs(got[k] - exact[k]) <= 0.03 * exact[k] for k in exact)

    assert close()
    index.compact()
    assert close()
    index.upsert(rows(spark, links_of(range(3990, 4000), to=700)))
    assert close()
    for f in (tmp_path / "index").rglob("*.parquet"):
        if not any(p.startswith("sketches-") for p in f.parts):
            f.write_bytes(b"")  # no row can be read any more
    assert close()
    index.upsert(rows(spark, links_of([5000])), count=False)
    assert index.stats()["backlinks"] is None


def test_sizes_that_ask_for_a_fold():
    assert stored.run_of([10, 10, 10]) == 0 and stored.run_of([10, 10, 10, 10]) == 4 and stored.run_of([1000, 10, 10, 10, 10]) == 4
    assert stored.run_of([1000, 20, 1]) == 0 and stored.run_of([]) == 0
    sizes, written = [], 0
    for _ in range(500):
        sizes.append(1)
        written += 1
        while n := stored.run_of(sizes):
            sizes[-n:] = [sum(sizes[-n:])]
            written += sizes[-1]
    assert len(sizes) < 20 and written < 500 * 10


def test_old_schemas_gain_columns(spark):
    old = merge.upsert(None, rows(spark, DATA)).drop("evidence_hash", "redirect_chain", "verification_status", "record_offset")
    new = merge.upgraded(old, 2)
    assert new.columns == [f.name for f in INDEX] and {tuple(r) for r in new.select("verification_status", "record_offset", "evidence_hash").collect()} == {("UNVERIFIED", None, "")}


def write_inputs(folder):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<a href=http://t.com/w>x\xff</a>"
    meta = {"Envelope": {"WARC-Header-Metadata": {"WARC-Target-URI": "http://m.com/"}, "Payload-Metadata": {"HTTP-Response-Metadata": {"HTML-Metadata": {"Links": [{"url": "http://t.com/m"}]}}}}}
    (folder / "a.csv").write_text("source_url,target_url\nhttp://c.com/,http://t.com/c\nhttp://c.com/2,http://t.com/c\n")
    (folder / "b.json").write_text('{"no": "array"}')
    (folder / "c.jsonl").write_text('{"source_url": "http://j.com/", "target_url": "http://t.com/j"}\n')
    (folder / "d.warc.gz").write_bytes(gzip.compress(record("response", "http://w.com/", page)) + gzip.compress(record("response", "http://w.com/2", page)))
    (folder / "e.wat").write_bytes(record("metadata", "", json.dumps(meta).encode()))
    (folder / "f.xyz").write_text("?")


def test_jobs_over_files_of_any_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_inputs(tmp_path / "in")
    spark.createDataFrame([("http://p.com/", "http://t.com/p")], "source_url string, target_url string").write.parquet(f"{tmp_path}/g.parquet")
    paths = [f"{tmp_path}/in", f"{tmp_path}/g.parquet"]
    index, log = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=4), jobs.Jobs(f"{tmp_path}/jobs")
    number = log.create("files", {})
    run = lambda job=number, **o: ingest.run_files(spark, log, job, paths, index, NOW, **o)
    assert run(max_files=2, at_once=1) == "completed"
    assert index.read().count() == 2 and log.load_checkpoint(number, "files") == {"files": 2, "records": 2}
    assert [e["context"] for e in log.errors()] == ["import"] and "b.json" in log.errors()[0]["detail"]
    log.control(number, pause=True)
    assert run() == "paused" and index.read().count() == 2
    log.control(number, pause=False)
    assert run(at_once=3) == "completed"
    wanted = {"http://c.com/", "http://c.com/2", "http://j.com/", "http://w.com/", "http://w.com/2", "http://m.com/", "http://p.com/"}
    assert {r["source_url"] for r in index.read().collect()} == wanted
    stats_ = log.get(number)["stats"]
    assert (stats_["files"], stats_["errors"], stats_["records_read"], stats_["inserted"]) == (7, 2, 7, 7)
    again = log.create("files", {})
    assert run(again) == "completed" and log.get(again)["stats"]["inserted"] == 0 and log.get(again)["stats"]["duplicates"] == 7
    few = log.create("files", {})
    assert run(few, max_records=3) == "completed" and log.load_checkpoint(few, "files")["records"] == 3
    assert stats.overview(index.read(), log, spark)["errors"] == 5 and stats.overview(index.read(), log, spark)["backlinks"] == 7
    feed = files.read_links(spark, f"{tmp_path}/in/[a]*")
    assert feed.count() == 2


def stops(index, log, number, files, bounds, spark):
    for most in bounds:
        assert ingest.run_files(spark, log, number, files, index, NOW, max_records=most, at_once=2) == "completed"


def test_a_job_goes_on_behind_any_record(spark, tmp_path):
    page = lambda k: f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<a href=http://t.com/{k % 3}>p{k}</a><a href=/own/{k}>q</a><a href=http://h:99999/>r</a>".encode()
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("source_url,target_url,anchor_text\n" + "".join(f"http://c.com/{k % 4},http://t.com/c,a{k}\n" for k in range(9)))
    (folder / "b.jsonl").write_text("\n".join(json.dumps({"source_url": f"http://j.com/{k % 3}", "target_url": "http://t.com/j", "anchor_text": f"b{k}"}) if k != 4 else "{broken" for k in range(8)))
    (folder / "c.json").write_text(json.dumps([{"source_url": f"http://j.com/{k % 5}", "target_url": "http://t.com/j", "anchor_text": f"c{k}"} for k in range(6)] + [7]))
    (folder / "d.warc.gz").write_bytes(b"".join(gzip.compress(record("response", f"http://w.com/{k % 4}", page(k))) for k in range(7)))
    (folder / "e.warc").write_bytes(record("response", "http://e.com/1", page(1)) + record("response", "http://e.com/2", page(2))[:-30])
    (folder / "f.csv").write_text("source_url,target_url\n")
    spark.createDataFrame([(f"http://p.com/{k}", "http://t.com/p") for k in range(5)], "source_url string, target_url string").repartition(2).write.parquet(f"{tmp_path}/g.parquet")
    files_ = [str(folder), f"{tmp_path}/g.parquet"]
    log, found = jobs.Jobs(f"{tmp_path}/jobs"), []
    for k, bounds in enumerate(([None], [4, 13, 25, None], [1, 26, 33, 10_000])):
        index = stored.StoredIndex(spark, f"{tmp_path}/index{k}", buckets=2)
        number = log.create("files", {})
        stops(index, log, number, files_, bounds, spark)
        found.append((same(index.read()), sorted((r["file"].rpartition("/")[2], r["context"], r["message"], r["detail"]) for r in index.rejected().collect())))
        assert log.get(number)["stats"]["records_read"] == 9 + 8 + 7 + 7 + 2 + 5 and log.get(number)["stats"]["malformed_records"] == 3, bounds
        assert log.get(number)["stats"]["errors"] == 0
        assert merge.integrity(index.read()).head() == (0, 0, 0)
        before = index.version()
        stops(index, log, number, files_, [None], spark)
        assert index.version() == before  # nothing is left to do
    assert all(f == found[0] for f in found[1:])
    assert len([r for r in found[0][1] if r[1] == "record"]) == 3 and [r[0] for r in found[0][1] if "of" in r[2] and "bytes" in r[2]] == ["e.warc"]
    assert len([r for r in found[0][1] if r[1] == "link" and "99999" in r[2]]) == 8


def test_files_without_rows_and_bad_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source_url,target_url\n")
    (tmp_path / "b.csv").write_text("source_url,target_url\nhttp://a.com/,\nhttp://b.com/,http://h:99999/\n")
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "d.json").write_text("{}")
    (tmp_path / "e.json").write_text(" []")
    (tmp_path / "f.csv").write_text("foo\n1\n")
    (tmp_path / "g.warc.gz").write_bytes(gzip.compress(record("response", "http://w.com/", b"x"))[:-9])
    index, log = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=2), jobs.Jobs(f"{tmp_path}/jobs")
    number = log.create("files", {})
    assert ingest.run_files(spark, log, number, [f"{tmp_path}/{x}" for x in ("a.csv", "b.csv", "c.jsonl", "d.json", "e.json", "f.csv", "g.warc.gz")], index, NOW, at_once=3) == "completed"
    stats_ = log.get(number)["stats"]
    assert (stats_["files"], stats_["errors"], stats_["inserted"]) == (7, 2, 0) and stats_["malformed_records"] == 2 and stats_["records_read"] == 4
    assert sorted(e["detail"].rpartition("/")[2] for e in log.errors()) == ["d.json", "f.csv"]
    got = {(r["file"].rpartition("/")[2], r["context"], r["message"]) for r in index.rejected().collect()}
    assert {("b.csv", "record", "no source_url or no target_url"), ("b.csv", "link", "an impossible port"), ("d.json", "import", "no JSON array")} <= got
    assert any(f == "g.warc.gz" and c == "record" for f, c, _ in got) and index.read().count() == 0


def test_a_repeated_micro_batch_is_left_out(spark, tmp_path):
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=2)
    merged = ingest.upsert_batches(index, NOW, "c", stream="s")
    lines = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    first = lines('{"source_url": "http://a.com/", "target_url": "http://t.com/"}', "{broken")
    merged(first, 0)
    version = index.version()
    merged(first, 0)
    assert index.version() == version and index.read().count() == 1 and index.rejected().count() == 1
    merged(lines('{"source_url": "http://b.com/", "target_url": "http://t.com/"}'), 1)
    assert index.read().count() == 2 and index.progress(0).head()["upto"] == 2


def test_one_archive_is_many_ranges(spark, tmp_path):
    rng = random.Random(2)
    page = lambda k: f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<title>{k}</title>{rng.random()}<a href=/x{k}>go</a>".encode() + gzip.compress(b"WARC/1.0\r\n") * (k % 3)
    parts = [record("warcinfo", "", b"i"), *(record("response", f"http://a.com/{k}", page(k)) for k in range(300))]
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts) + b"\0" * 100)
    (tmp_path / "n.warc").write_bytes(b"".join(parts))
    (tmp_path / "o.warc.gz").write_bytes(gzip.compress(b"".join(parts)))  # one member
    (tmp_path / "p.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts)[:-20])
    names = {f"{tmp_path}/{n}" for n in ("m.warc.gz", "n.warc", "o.warc.gz", "p.warc.gz")}
    found = warc.members(spark, sorted(names)).persist()
    counts = {r["path"].rpartition("/")[2]: r["count"] for r in found.groupBy("path").count().collect()}
    assert counts == {"m.warc.gz": 301, "n.warc": 301, "o.warc.gz": 1, "p.warc.gz": 301}
    ranges = warc.split(found, 6000)
    assert ranges.where("path like '%m.warc.gz'").count() > 5 < ranges.where("path like '%n.warc'").count()
    got = warc.scan_ranges(ranges, tasks=7)
    key = lambda r: (r["filename"], r["position"], r["record_type"], r["target_uri"], r["error"], None if r["payload"] is None else bytes(r["payload"]))
    assert sorted(map(str, map(key, got.collect()))) == sorted(map(str, map(key, warc.scan(spark, sorted(names)).collect())))
    seen = {r[0] for r in got.where("filename = 'm.warc.gz'").select(F.spark_partition_id()).distinct().collect()}
    assert len(seen) > 1
    captures = found.where("path like '%m.warc.gz'").orderBy("offset").limit(40).unionByName(found.where("path like '%m.warc.gz'").orderBy(F.desc("offset")).limit(3))
    near = warc.near(captures.unionByName(captures), gap=100).collect()
    assert sorted(len(r["parts"]) for r in near) == [3, 40]
    some = warc.read_ranges(spark, captures)
    assert sorted(int(r["target_uri"].rpartition("/")[2]) for r in some.collect()) == [*range(39), 297, 298, 299]
    assert {(r["record_offset"], r["record_length"]) for r in some.collect()} <= {(r["offset"], r["length"]) for r in captures.collect()}
    found.unpersist()


def test_written_archives_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(f"http://a.com/{k}", f"<p>é{k}</p><a href=/b>\r\n\r\nWARC/1.0\r\n</a>") for k in range(50)] + [("http://b.com/", None)], "url string, html string")
    warc.write_warc(pages.repartition(3), f"{tmp_path}/out")
    got = warc.read_warc(spark, f"{tmp_path}/out").collect()
    assert {(r["target_uri"], bytes(r["payload"]).decode()) for r in got} == {(r["url"], r["html"] or "") for r in pages.collect()}
    assert not (tmp_path / "out/_pending").exists() and len(list((tmp_path / "out").glob("*.warc.gz"))) == 3


def test_captures_of_one_url_are_told_apart(spark, tmp_path):
    """Of pages with one url, those that are captured give their links, as often as they are there."""
    page = lambda k: (k, "http://a.com/p", f"<a href=/{k % 4}>x</a>")
    spark.createDataFrame([page(k) for k in range(20)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["target_url"], r["n"]) for r in catalogue.QUERIES["archived_captures"](spark, str(tmp_path)).collect()}
    wanted = [f"http://a.com/{k % 4}" for k in range(20) if k % 5 < 2]
    assert got == {(u, wanted.count(u)) for u in wanted}


def test_pages_by_seek(spark):
    rng = random.Random(5)
    data = [(k, rng.choice([None, "a", "b", "B", ""]), rng.choice([None, 200, 404])) for k in range(83)]
    index = spark.createDataFrame(data, "id long, anchor_text string, source_http_status int").withColumns({"last_seen_at": F.lit("x")}).persist()
    for column in ("anchor_text", "source_http_status", "unknown"):
        for descending in (True, False):
            search = Search(sort_by=column, descending=descending)
            pages_ = list(search.walk(index, 10))
            assert [r["id"] for p in pages_ for r in p] == [r["id"] for r in search.sorted(index).collect()] and [len(p) for p in pages_] == [10] * 8 + [3]
    plan = Search(sort_by="anchor_text").after(index, ("a", 5), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    index.unpersist()


def test_links_by_a_table_of_targets(spark):
    wanted = [("t.com", "root_domain"), ("HTTP://www.T.com/x", "exact_hostname"), ("https://www.t.com/x", "exact_url"), ("t.com/docs", "path_prefix"), ("t.com/docs/a", "path_prefix"), ("t.com", "path_prefix"), ("u.co.uk", "anything"), ("", "root_domain"), (None, "root_domain"), ("t.com", "root_domain")]
    links = [("https://www.t.com/x",), ("http://t.com/docs/abc",), ("http://a.t.com/doc",), ("http://nott.com/docs/a",), ("http://x.u.co.uk/",), ("https://www.t.com/X",), ("http://t.com/docs/abc",), (None,), ("",)]
    frame = urls.with_normalized(spark.createDataFrame(links, "url string"), {"url": ("u", "h")})
    targets = spark.createDataFrame(wanted, "target string, mode string")
    found = verify.links_to(frame, targets, "u", "h")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["url"], r["target"], r["mode"]) for r in found.collect())
    by_hand = []
    for t in dict.fromkeys(w for w in wanted if w[0] is not None):
        hits = frame.where(matches_link(F.col("u"), Target(*t), F.col("h"))).select("url").collect()
        by_hand += [(r["url"], *t) for r in hits]
    assert got == sorted(by_hand) and len(got) > 10
    page = spark.createDataFrame([("http://p/", 200, b"<a href=http://t.com/docs/abc>", None)], "url string, status int, body binary, error string").withColumn("final_url", F.lit(None).cast("string"))
    assert {(r["target"], r["mode"]) for r in verify.matching_links(page, targets).collect()} == {("t.com", "root_domain"), ("t.com/docs", "path_prefix"), ("t.com/docs/a", "path_prefix"), ("t.com", "path_prefix")}


def test_a_list_keeps_its_order(spark, tmp_path):
    (tmp_path / "l.txt").write_text("http://b/\n\n http://a/ \nhttp://b/\nhttp://none/\n")
    listed = records.read_list(spark, f"{tmp_path}/l.txt")
    assert [tuple(r) for r in listed.orderBy("place").collect()] == [(0, "http://b/"), (2, "http://a/"), (3, "http://b/"), (4, "http://none/")]
    results = spark.createDataFrame([("http://a/", "REMOVED"), ("http://b/", "LIVE_CONFIRMED")], "source_url string, verification_status string")
    assert [tuple(r) for r in verify.in_order(listed, results).collect()] == [(0, "http://b/", "LIVE_CONFIRMED"), (2, "http://a/", "REMOVED"), (3, "http://b/", "LIVE_CONFIRMED"), (4, "http://none/", None)]


def test_stored_verification_and_migration(spark, tmp_path):
    index = stored.StoredIndex(spark, f"{tmp_path}/index", buckets=8)
    index.upsert(rows(spark, links_of(range(60))))
    index.compact()
    before, plain = index.manifest()["base"], index.read()
    ids = [r["id"] for r in plain.where("normalized_target_domain = 't3.com'").limit(2).collect()]
    results = spark.createDataFrame([(i, "REMOVED", 410, "text/html", 0, "[]", "", "c") for i in [*ids, 10**9]], "id long, verification_status string, source_http_status int, content_type string, live_backlink_present int, redirect_chain string, evidence_hash string, last_checked_at string")
    wanted = same(verify.apply_verification(plain, results, LATER))
    assert index.apply_verification(results, LATER) == 2 and same(index.read()) == wanted
    assert len([u for u in before if before[u] != index.manifest()["base"].get(u)]) == 1 < len(before)
    assert index.apply_verification(results.where("id = 1000000000"), LATER) == 0
    legacy = spark.createDataFrame([("http://old.com/", "http://new.com/", "x"), ("http://old.com/", "http://new.com/", "y"), (None, "http://t.com/", "z")], "source string, to_url string, anchor string")
    assert index.migrate(legacy, NOW) == 2 and index.migrate(legacy, NOW) == 0 and index.read().count() == 62
    assert index.search(Search(target="http://new.com/", mode="exact_url")).head()["verification_status"] == "UNVERIFIED"
    assert merge.integrity(index.read()).head() == (0, 0, 0)


def test_robots_and_logs(tmp_path):
    text = "User-agent: *\nDisallow: /private\n"
    assert robots.can_fetch(text, "x", "http://a.com/") and not robots.can_fetch(text, "x", "http://a.com/private/1") and robots.can_fetch(None, "x", "http://a.com/private")
    log = logs.logger(str(tmp_path), "t", most_bytes=200, older=1)
    assert logs.logger(str(tmp_path), "t") is log and len(log.handlers) == 1
    for _ in range(20):
        log.info("a line of some length")
    assert (tmp_path / "t.log.1").exists() and (tmp_path / "t.log").stat().st_size < 300


def test_verification_of_several_targets(spark):
    frame = spark.createDataFrame([("http://a/", 200, b"<a href=http://t.com/>", None), ("http://b/", 200, b"<a href=http://u.com/x>", None), ("http://c/", 200, b"<a href=http://v.com/>", None)], "url string, status int, body binary, error string")
    frame = frame.withColumns({"final_url": F.lit(None).cast("string"), "content_type": F.lit(""), "redirect_chain": F.lit(None).cast("array<string>")})
    got = verify.verify(frame, [Target("t.com"), Target("http://u.com/x", "exact_url")]).collect()
    assert [r["live_backlink_present"] for r in got] == [1, 1, 0]
    found = verify.matching_links(frame, [Target("t.com"), Target("http://u.com/x", "exact_url")]).collect()
    assert {(r["source_url"], r["target_url"]) for r in found} == {("http://a/", "http://t.com/"), ("http://b/", "http://u.com/x")}


def test_streaming_ingestion_and_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"source_url": "http://a.com/", "target_url": "http://t.com/"}\nbroken\n')
    index, log = stored.StoredIndex(spark, f"{tmp_path}/index"), jobs.Jobs(f"{tmp_path}/jobs")
    number = log.create("file", {"path": "in"})
    run = lambda: ingest.run_job(spark, log, number, f"{tmp_path}/in", index, f"{tmp_path}/cp", NOW)
    assert run() == "completed" and index.read().count() == 1
    assert log.get(number)["stats"]["inserted"] == 1 and log.get(number)["stats"]["malformed_records"] == 1
    (tmp_path / "in" / "2.jsonl").write_text('{"source_url": "http://a.com/", "target_url": "http://t.com/"}\n{"source_url": "http://b.com/", "target_url": "http://t.com/", "collection": "c"}\n')
    assert run() == "completed" and index.read().count() == 2  # only the new file is read
    assert log.get(number)["stats"]["duplicates"] == 1 and log.load_checkpoint(number, "batch") == {"batch": 1}
    assert index.delete_collection("c") == 1 and index.read().count() == 1 and index.compact() == index.version()
    log.record_error("x", "m", number)
    log.add_history("t.com", "root_domain", 3)
    assert log.frame(spark, "errors").count() == 1 and log.history()[0]["result_count"] == 3
    log.clear_errors()
    assert log.errors() == [] and log.list(active_only=True) == []


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    write_inputs(tmp_path / "in")
    run = lambda *words: cli.main([f"--index={tmp_path}/index", f"--jobs={tmp_path}/jobs", *words], spark)
    assert run("search", "t.com") == 1 and run("pause", "7") == 1
    assert run("build", f"{tmp_path}/in", "--max-files", "1") == 0
    assert run("pause", "1") == 0 and run("build", f"{tmp_path}/in", "--job", "1") == 0
    assert '"state": "paused"' in capsys.readouterr().out
    assert run("resume", "1") == 0 and run("build", f"{tmp_path}/in", "--job", "1") == 0
    assert '"state": "completed"' in capsys.readouterr().out
    assert run("search", "http://T.com/any", "--size", "4", "--sort", "source_url", "--ascending") == 0
    out = capsys.readouterr().out
    assert "page 2 of 2" in out and out.count("http://t.com/") == 6
    assert run("search", "t.com", "--where", "link_types=UNKNOWN", "--where", "unique_source_domain", "--pages", "1") == 0
    assert capsys.readouterr().out.count("http://t.com/") == 4
    assert run("search", "t.com", "--export", "source_urls", "--to", f"{tmp_path}/out") == 0
    assert spark.read.text(f"{tmp_path}/out").count() == 6
    frame = spark.createDataFrame([("http://a/", 200, b"<a href=http://t.com/>")], "url string, status int, body binary")
    frame.withColumns({"final_url": F.col("url"), "content_type": F.lit(""), "error": F.lit(None).cast("string"), "redirect_chain": F.array().cast("array<string>")}).write.parquet(f"{tmp_path}/f")
    capsys.readouterr()
    assert run("verify", f"{tmp_path}/f", "t.com", "u.com") == 0
    assert json.loads(capsys.readouterr().out)["live_backlink_present"] == 1
    assert run("status") == 0 and '"errors": 2' in capsys.readouterr().out
    assert run("selftest") == 0
