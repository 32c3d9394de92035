import random

import pytest
from pyspark.sql import functions as F

from quern.functions.dates import date_from_url, effective_date, norm_date
from quern.functions.text import site, strip, terms, url_host
from quern.functions.weights import build_weights, parse_weights
from quern.operators import crawl, evaluation, explain, fusion, ingest, ranking, search, vectors
from quern.sources import feeds, html, http, tables

CAND = "qid int, route int, doc_id string, rank int, weight double"


def candidates(spark, routes, weights):
    rows = [(1, r, d, k, w) for r, (ids, w) in enumerate(zip(routes, weights, strict=True)) for k, d in enumerate(ids)]
    return spark.createDataFrame(rows, CAND)


def fused(spark, routes, weights, **kw):
    rows = fusion.top_k(fusion.rrf_fuse(candidates(spark, routes, weights), **kw), 99).orderBy("place").collect()
    return [(r.doc_id, r.score, r.n_routes) for r in rows]


def test_rrf_is_zero_based_weighted_and_breaks_ties_by_id(spark):
    assert fused(spark, [["a"]], [1.0]) == [("a", 1 / 60, 1)]
    got = fused(spark, [["a", "b"], ["c", "a"]], [1.0, 0.15])
    assert [g[0] for g in got] == ["a", "b", "c"]
    assert got[0][1] == pytest.approx(1 / 60 + 0.15 / 61) and [g[2] for g in got] == [2, 1, 1]
    assert [g[0] for g in fused(spark, [["b"], ["a"]], [1.0, 1.0])] == ["a", "b"]


def test_rrf_repeats_and_damping(spark):
    (one,) = fused(spark, [["a", "a"]], [1.0])
    assert one[1] == pytest.approx(1 / 60 + 1 / 61) and one[2] == 2
    assert fused(spark, [["a", "a"]], [1.0], dedup=True)[0][1] == pytest.approx(1 / 60)
    for damp, a in ((1.0, 1 / 60 + 0.3 / 60), (0.0, 1 / 60)):
        got = dict((d, s) for d, s, _ in fused(spark, [["a", "b"], ["a", "c"]], [1.0, 0.3], dampen=damp))
        assert got["a"] == pytest.approx(a) and got["c"] == pytest.approx(0.3 / 61)
    for bad in ({"k": 0}, {"dampen": 1.5}):
        with pytest.raises(ValueError):
            fusion.rrf_fuse(candidates(spark, [["a"]], [1.0]), **bad)


def test_rrf_equals_a_plain_model_on_random_candidates(spark):
    rng = random.Random(3)
    routes = [[f"d{rng.randrange(12)}" for _ in range(8)] for _ in range(4)]
    weights, want = [1.0, 0.2, 0.2, 0.2], {}
    for r, (ids, w) in enumerate(zip(routes, weights, strict=True)):
        for k, d in enumerate(dict.fromkeys(ids)):
            want[d] = want.get(d, 0) + w / (60 + k) * (0.35 if r and d in routes[0] else 1)
    got = {d: s for d, s, _ in fused(spark, routes, weights, dedup=True, dampen=0.35)}
    assert got == pytest.approx(want)


def test_weights():
    assert build_weights(4) == [1.0] + [0.15] * 4
    assert build_weights(0) == [1.0]
    assert build_weights(3, [0.5]) == [0.5] * 4
    assert build_weights(2, [1.0, 0.2, 0.3]) == [1.0, 0.2, 0.3]
    assert build_weights(2, rewrite=0.3, share_budget=False) == [1.0, 0.3, 0.3]
    for wrong in ([1.0, 0.1, 0.1], []):
        with pytest.raises(ValueError):
            build_weights(4, wrong)
    assert parse_weights("1.0, ,0.15") == [1.0, 0.15] and parse_weights("") is None


def test_dates(spark):
    df = spark.createDataFrame([("2026-3-7T10:00", "2026-03-07"), ("Sat, 07 Mar 2026 10:00:00 GMT", "2026-03-07"), ("", ""), (None, ""), ("2026/13/45", "2026-13-45")], "s string, want string")
    assert all(r.got == r.want for r in df.select("want", norm_date(F.col("s")).alias("got")).collect())
    urls = spark.createDataFrame([("https://a.example/2026/3/7/x", "2026-03-07"), ("https://a.example/2026-03-7-x", "2026-03-07"), ("https://a.example/x", "")], "u string, want string")
    assert all(r.got == r.want for r in urls.select("want", date_from_url(F.col("u")).alias("got")).collect())
    run = F.lit("2026-01-01").cast("date")
    eff = spark.createDataFrame([("2026-02-30", "/2026/13/45/"), ("", "x"), ("2025-05-05", "x")], "d string, u string").select(effective_date(F.col("d"), F.col("u"), run).cast("string").alias("e")).collect()
    assert [r.e for r in eff] == [None, "2026-01-01", "2025-05-05"]


def test_site_and_host(spark):
    rows = [("HTTPS://User@WWW.Foo.Example.:80/a?b", "foo.example"), ("http://a.example#x", "a.example"), ("import/a.md", "import/a.md"), (None, None)]
    got = spark.createDataFrame(rows, "u string, want string").select("want", site(F.col("u")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    assert spark.range(1).select(url_host(F.lit("http://a:80/b")).alias("h")).first().h == "a:80"
    assert spark.range(1).select(strip(F.lit("　 a\t\n")).alias("h")).first().h == "a"


def test_terms_of_two_scripts_and_of_nothing(spark):
    got = spark.createDataFrame([("Row-lock 数据库 x1",), ("",), (None,)], "t string").select(terms(F.col("t")).alias("w")).collect()
    assert sorted(got[0].w) == sorted(["row", "lock", "x1", "数据", "据库"]) and got[1].w == [] and got[2].w is None


def test_group_ranks_and_cdf_equal_sorting(spark):
    rng = random.Random(1)
    rows = [(("hot" if rng.random() < 0.6 else rng.choice("abc")), rng.randrange(9) / 8, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    got = ranking.group_ranks(df, ["g"], [F.desc("v"), F.col("id")], size="n").collect()
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r.id for r in mine] == [w[2] for w in want] and {r.n for r in mine} == {len(want)}
    for r in ranking.group_cdf(df, ["g"], "v").collect():
        same = [x[1] for x in rows if x[0] == r.g]
        assert r.below == sum(x < r.v for x in same) and r.upto == sum(x <= r.v for x in same) and r.size == len(same)
    assert ranking.group_ranks(df.limit(0), ["g"], [F.col("id")]).count() == 0


def test_scan_diagnosis(spark):
    rows = [(1, 0, "a", 0, 1.0, 0.1), (1, 0, "b", 1, 1.0, 0.2), (1, 1, "c", 0, 0.15, 0.1), (1, 1, "a", 1, 0.15, 0.2)]
    scans = spark.createDataFrame(rows, CAND.replace("weight double", "weight double, distance double"))
    ask = lambda d: explain.diagnose(scans, spark.createDataFrame([(1, d)], "qid int, doc_id string")).first()
    assert ask("b").verdict == "recalled by the original query only" and ask("c").verdict == "recalled by rewrites only"
    assert ask("a").verdict == "in the top k" and ask("z").verdict == "not recalled by any route" and ask("z").fused_rank is None
    first = explain.first_by_route(scans, spark.createDataFrame([(1, "b")], "qid int, doc_id string")).first()
    assert (first.route, first["rank"], first.distance) == (0, 1, 0.2)


def test_nearest_vectors_equal_brute_force(spark):
    rng = random.Random(2)
    vecs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)] + [[0.0] * 8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)] + [(99, None)], "doc_id long, vec array<float>")
    got = vectors.cosine_topk(df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), df, 5, block=16).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    for q in (0, 20, 40):
        want = sorted((round(1 - cos(vecs[q], v), 5), i) for i, v in enumerate(vecs[:60]))[:5]
        assert [r.doc_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == [i for _, i in want]
    assert not any(r.qid == 60 for r in got)


def test_manifest_round_trip_and_merge(spark, tmp_path):
    path = str(tmp_path / "m")
    assert tables.read_manifest(spark, path).count() == 0
    one = spark.createDataFrame([("u", "s1", 1, 5, "2025"), ("u", "s2", 1, 5, "2026"), ("v", "s3", 0, 1, "2025")], tables.MANIFEST)
    tables.write_manifest(ingest.merge_manifest(one.limit(0), one), path)
    fresh = spark.createDataFrame([("v", "s4", 2, 1, "2024")], tables.MANIFEST)
    tables.write_manifest(ingest.merge_manifest(tables.read_manifest(spark, path), fresh), path)
    state = lambda: {(r.source_doc, r.sha256) for r in tables.read_manifest(spark, path).collect()}
    assert state() == {("u", "s2"), ("v", "s4")}
    # changes are appended; a version whose writer died has no marker and doesn't count
    tables.append_manifest(spark.createDataFrame([("w", "s5", 1, 1, "2026")], tables.MANIFEST), path)
    (tmp_path / "m" / "whole-00000009").mkdir()
    assert state() == {("u", "s2"), ("v", "s4"), ("w", "s5")}
    for k in range(tables.MOST_CHANGES + 1):
        tables.append_manifest(spark.createDataFrame([("w", f"t{k}", 1, 1, "2026")], tables.MANIFEST), path)
    assert ("w", f"t{tables.MOST_CHANGES}") in state() and len(tables.manifest_versions(spark, path)) <= tables.MOST_CHANGES


def test_a_broken_manifest_is_empty_and_another_table_an_error(spark, tmp_path):
    broken = tmp_path / "b" / "whole-00000001"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    (broken / "_SUCCESS").touch()
    assert tables.read_manifest(spark, str(tmp_path / "b")).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "o" / "whole-00000001"))
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "o"))


def test_streamed_manifest(spark, tmp_path):
    from quern.streaming.manifest import follow

    source, schema = str(tmp_path / "in"), "source_doc string, text string, chunks int, stored_at string"
    for text in ("one", "two"):
        spark.createDataFrame([("u", text, 1, text), (None, "x", 1, "")], schema).write.mode("append").parquet(source)
        follow(spark.readStream.schema(schema).parquet(source), str(tmp_path / "m"), str(tmp_path / "c")).awaitTermination(60)
    (row,) = tables.read_manifest(spark, str(tmp_path / "m")).collect()
    assert row.stored_at == "two"


def test_crawl_status_takes_the_first_that_holds(spark):
    long = "x" * 700
    items = spark.createDataFrame([("s", None, "t", long), ("s", "u1", "t", long), ("s", "u2", "t", None), ("s", "u3", "t", " a "), ("s", "u4", "t", "# " + long), ("s", "u5", "t", long)], "source string, url string, title string, body string")
    import hashlib

    known = spark.createDataFrame([("u4", hashlib.sha256(("# " + long).encode()).hexdigest(), 1, 1, "x")], tables.MANIFEST)
    got = ingest.crawl_status(items, known, spark.createDataFrame([("u1",)], "url string"))
    assert {r.url: r.status for r in got.collect()} == {None: "fail", "u1": "skip", "u2": "fail", "u3": "skip", "u4": "unchanged", "u5": "ok"}
    stats = ingest.source_stats(got).first()
    assert (stats.ok, stats.skip, stats.fail, stats.unchanged, stats.avg_words) == (1, 2, 2, 1, 705)


def test_rewriting(spark):
    df = spark.createDataFrame([("row lock, 行锁;index，- page cache\nx",)], "raw string")
    assert df.select(search.parse_variants(F.col("raw")).alias("v")).first().v == ["row lock", "index", "page cache"]
    q = spark.createDataFrame([(1, "  ", ["a"]), (2, " q ", None), (3, "q", ["a1", None, "", "b1", "c1", "d1", "e1"])], "qid int, query string, variants array<string>")
    got = {}
    for r in search.routes(q).orderBy("qid", "route").collect():
        got.setdefault(r.qid, []).append((r.query, r.weight))
    assert got == {2: [("q", 1.0)], 3: [("q", 1.0), ("a1", 0.15), ("b1", 0.15), ("c1", 0.15), ("d1", 0.15)]}


PAGE = """<html><head><title>Site</title></head><body><nav>menu words</nav><main><article><h1>A fine title</h1><p>First paragraph with enough words.</p>
<h2>ab</h2><pre>code  here</pre><img class="ad"><p>Second paragraph stays.</p><p><a href=x>one</a><a href=y>two</a></p></article></main>
<aside class="sidebar">side words</aside><div class="related-posts">related words</div><footer>foot</footer><script>var x</script></body></html>"""


def test_article_from_page(spark):
    used = html.used_blocks(F.col("b"))
    row = spark.createDataFrame([(PAGE,), (None,)], "h string").select(html.html_blocks(F.col("h")).alias("b")).select(html.article_title(used).alias("t"), html.article_body(used).alias("m")).collect()
    assert row[0].t == "A fine title" and row[1].m == ""
    for kept in ("# A fine title", "## ab", "```\ncode  here\n```", "First paragraph", "Second paragraph stays."):
        assert kept in row[0].m
    for gone in ("menu", "side words", "related", "foot", "var x", "one two"):
        assert gone not in row[0].m


def test_feeds(spark):
    rss = "<rss><channel><item><title>T</title><link>/a</link><pubDate>Sat, 07 Mar 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="https://b.example/e"/><updated>2026-01-02T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("r", "https://a.example/feed", rss), ("a", "", atom), ("x", "", "<broken"), ("n", None, None)], "source string, base_url string, xml string")
    got = {r.source: (r.title, r.url, r.date, r.summary) for r in feeds.feed_items(df).collect()}
    assert got == {"r": ("T", "https://a.example/a", "2026-03-07", "Hi"), "a": ("E", "https://b.example/e", "2026-01-02", "")}


def test_fetching_retries_only_what_may_succeed():
    def answers(*codes):
        calls, waits, left = [], [], list(codes)

        def get(url):
            calls.append(url)
            code = left.pop(0)
            if code is None:
                raise OSError
            return code, {"Retry-After": "99"} if code == 429 else {}, b"body"

        return http.fetch("u", get, waits.append), len(calls), waits

    assert answers(503, None, 200) == ((200, "body", None), 3, [1.5, 3.0])
    assert answers(404)[1] == 1 and answers(429, 200)[2] == [30.0]
    assert http.robots_allow(404, "", "https://a/x") and not http.robots_allow(500, "", "https://a/x")
    assert not http.robots_allow(200, "User-agent: *\nDisallow: /x", "https://a/x/1") and http.robots_allow(200, "User-agent: *\nDisallow: /x", "https://a/y")


def test_no_page_ends_the_job():
    import gzip
    from http.client import IncompleteRead

    zipped = gzip.compress("Größe".encode() * 50)
    quiet = lambda _: None
    assert http.fetch("u", lambda _: (200, {}, zipped), quiet)[1].startswith("Größe")
    assert http.fetch("u", lambda _: (200, {}, zipped[:-9]), quiet) == (200, "", "EOFError")

    def fail(e):
        def get(_):
            raise e

        return get

    assert http.fetch("u", fail(IncompleteRead(b"")), quiet)[2] == "IncompleteRead"
    assert http.fetch("http://[", fail(ValueError("bad")), quiet)[2] == "ValueError: bad"
    assert http.decode_body('<meta CHARSET="GBK">中'.encode("gbk")) == '<meta CHARSET="GBK">中'
    assert http.decode_body(b"<meta charset=nonsense>\xc3\xa9").endswith("é")
    assert http.wait_asked({"retry-after": "2.5"}) == 2.5 and http.wait_asked({"Retry-After": "0"}) is None and http.wait_asked({"Retry-After": "Sat, 07 Mar 2026"}) is None
    assert http.origin_of("http://[") is None and http.origin_of("mailto:x") is None and http.origin_of("https://a.example:1/x") == "https://a.example:1"


def test_links_and_titles_of_odd_feeds():
    atom = "<?xml version='1.0' encoding='utf-16'?><feed><entry><title>A &lt;b&gt;bold&lt;/b&gt; title</title><link/><link href='/x'/></entry></feed>"
    assert feeds.parse_feed(atom, "https://a.example/") == [("A bold title", "https://a.example/x", "", "")]
    assert feeds.parse_feed("\n <?xml version='1.0'?><rss><item><title>T</title><link>u</link></item></rss>", "")[0][:2] == ("T", "u")


def test_blocks_of_nested_and_broken_markup():
    assert html.read_blocks("<p>One <a href=x>two</a> three") == [("text", "One two three", False, 3)]
    assert html.read_blocks("<div class='ad'>x<p>y</p></div>z<br/>w") == [("text", "z", False, 0), ("text", "w", False, 0)]
    assert html.read_blocks("<main><h2>H</h2>\n<pre>a  b\n c</pre></main>") == [("h2", "H", True, 0), ("pre", "a  b\n c", True, 0)]
    assert html.read_blocks(None) == [] and html.strip_markup("<nav>only menu</nav>") == "only menu"


def test_chunks_have_their_text_and_section(spark):
    text = "intro\n# One\n" + "a" * 2500 + "\n## Two\nb"
    rows = ingest.two_level_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("section_no", "parent_no", "child_no").collect()
    assert {r.section for r in rows} == {"", "One", "Two"} and {r.doc_id for r in rows} == {1}
    one = [r for r in rows if r.section == "One" and r.parent_no == 0]
    assert all(r.text in r.parent_text and r.chars == len(r.text) for r in rows)
    assert one[0].text + "".join(r.text[60:] for r in one[1:]) == one[0].parent_text and len(one[0].parent_text) == 2000


def test_a_crawl_is_one_job_that_survives_its_pages(spark):
    body = "<html><body><article><h1>Title of {n}</h1><p>" + "Words that make a paragraph long enough. " * 40 + "</p></article></body></html>"

    def get(url):
        if url.endswith("/robots.txt"):
            return (200, {}, b"User-agent: *\nDisallow: /private") if "a.example" in url else (404, {}, b"")
        if "broken" in url:
            raise RuntimeError("boom")
        if "gone" in url:
            return 404, {}, b""
        return 200, {}, (b"<p>short</p>" if "short" in url else body.replace("{n}", url[-1]).encode())

    names = ["https://a.example/1", "https://a.example/2", "https://a.example/private", "https://a.example/broken", "https://b.example/gone", "https://b.example/short", "https://b.example/held", None, "not an address"]
    items = spark.createDataFrame([("s", "t", u, "2026-01-02") for u in names], "source string, title string, url string, date string")
    store = spark.createDataFrame([(1, "https://b.example/held", "other", True, None, 0, "x", "", "v1", None, ["public"]), (2, "https://a.example/1", "blog", True, None, 0, "old", "", "v1", None, ["public"])], "id long, source_doc string, collection string, is_parent boolean, parent_id long, chunk_index int, text string, section string, doc_version string, effective_date date, acl array<string>")
    run = lambda m, **kw: crawl.crawl(items, store, m, collection="blog", acl=["public"], run_date="2026-03-01", stored_at="2026", get=get, sleep=lambda _: None, **kw)
    got = run(spark.createDataFrame([], tables.MANIFEST))
    fate = {r.url: (r.status, r.reason) for r in got.status.collect()}
    assert fate == {
        names[0]: ("ok", None), names[1]: ("ok", None), names[2]: ("skip", "robots"), names[3]: ("fail", "RuntimeError: boom"), names[4]: ("fail", "HTTP 404"),
        names[5]: ("skip", "too short"), names[6]: ("skip", "another collection has it"), None: ("fail", "no address"), names[8]: ("fail", "bad address"),
    }
    parents = got.store.where("is_parent").collect()
    assert {r.source_doc for r in parents} == {*names[:2], names[6]} and "old" not in {r.text for r in parents}
    assert {str(r.effective_date) for r in parents if r.collection == "blog"} == {"2026-01-02"} and got.chunks.where("not is_parent").join(got.chunks.where("is_parent").selectExpr("id AS parent_id"), "parent_id", "left_anti").count() == 0
    stats = got.stats.first()
    assert (stats.ok, stats.skip, stats.fail) == (2, 3, 4) and stats.chunks == got.chunks.where("not is_parent").count() and "HTTP 404" in stats.fail_reasons
    again = run(got.manifest)
    assert {r.url for r in again.status.where("status = 'unchanged'").collect()} == set(names[:2]) and again.chunks.count() == 0
    assert again.stats.first().saved_chunks == stats.chunks and run(got.manifest, force=True).status.where("status = 'ok'").count() == 2


def test_articles_of_an_api(spark):
    get = lambda url: (404, {}, b"") if url.endswith("robots.txt") else (200, {}, b'{"body_markdown": "# M"}') if url.endswith("/1") else (200, {}, b"no json")
    ids = spark.createDataFrame([(1,), (2,), (None,)], "api_id long")
    assert {(r.api_id, r.markdown) for r in http.api_markdown(ids, "https://api.example/articles/{}", get=get, sleep=lambda _: None).collect()} == {(1, "# M"), (2, "")}


DOCS = [(1, "row lock in the storage engine", "c", ["public"]), (2, "vector index and row store", "c", ["team"]), (3, "page cache", "d", ["public"]), (4, "row lock row lock", "c", ["public"]), (5, None, "c", ["public"])]


def test_search_by_two_routes_access_and_reranking(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, collection string, acl array<string>")
    q = spark.createDataFrame([(1, "row lock", ["page cache"]), (2, " ", None)], "qid long, query string, variants array<string>")
    found = lambda **kw: [(r.qid, r.doc_id) for r in search.search(q, docs, **kw).orderBy("qid", "place").collect()]
    assert found()[0] == (1, 4) and {x for x, _ in found()} == {1} and found(k=0) == []
    assert {i for _, i in found(collection="c", acl=["public"])} <= {1, 4}
    backwards = lambda hits: hits.withColumn("rank", 100 - F.col("rank")).select("qid", "route", "doc_id", "rank")
    assert found(rerank=backwards)[0] != (1, 4)
    weights = {r.route: r.weight for r in search.routes(q, weights=[0.5]).collect()}
    assert weights == {0: 0.5, 1: 0.5}
    with pytest.raises(Exception, match="weights don't fit"):
        search.routes(q, weights=[1.0, 0.1, 0.1]).collect()


def test_explained_search(spark):
    import json

    docs = spark.createDataFrame(DOCS, "doc_id long, text string, collection string, acl array<string>")
    q = spark.createDataFrame([(1, "row lock", ["page cache"])], "qid long, query string, variants array<string>")
    hits, target = explain.explained(q, docs, spark.createDataFrame([(1, 3)], "qid long, doc_id long"), k=2)
    assert explain.scan_depth(5) == 100 and explain.scan_depth(20) == 200 and explain.scan_depth(5, 7) == 7
    got = json.loads(explain.explain_json(hits, target).first().json)
    assert [h["rank"] for h in got["hits"]] == [1, 2] and got["hits"][0]["route_detail"][0]["label"] == "original"
    assert got["target"]["fused_rank"] >= 1 and got["target"]["verdict"]


def test_evaluation_runs_the_search(spark):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t, _, _ in DOCS], "doc_id long, text string, source_doc string")
    q = spark.createDataFrame([(1, "row lock", None), (2, "nothing here", None)], "qid long, query string, variants array<string>")
    truth = spark.createDataFrame([(1, "s4"), (2, "s3")], "qid long, source_doc string")
    got = evaluation.evaluate(q, truth, docs, k=1, vector=False).first()
    assert (got.n, got.recall, got.mrr) == (2, 0.5, 0.5)
    kept = evaluation.search_retention(q, docs, k=2).first()
    assert kept.top_retention == 1.0 and kept.rewrite_only_per_query == 0.0


def test_answers_become_an_evaluation_set(spark):
    docs = spark.createDataFrame([(f"u{k}", "t" * 200, 2000) for k in range(4)], "source_doc string, title string, chars long")
    raw = spark.createDataFrame([("u0", ' "行锁 等待"\nmore'), ("u1", "no ideographs"), ("u2", "短"), ("u3", None)], "source_doc string, raw string")
    (row,) = evaluation.build_set(docs, raw).collect()
    assert row.source_doc == "u0" and row.query.startswith("行锁 等待") and len(row.title) == 120


def test_rewriting_only_where_it_is_needed(spark):
    q = spark.createDataFrame([(1, "行锁", "a"), (2, "row lock", "b"), (3, "索引", "c")], "qid long, query string, key string")
    cache = spark.createDataFrame([("a", ["row lock, 行", "x"]), ("b", ["other"])], "qhash string, variants array<string>")
    assert {r.qid: r.variants for r in search.rewritten(q, cache).collect()} == {1: ["row lock"], 2: [], 3: []}


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_best_of_many_blocks_equal_sorting():
    import numpy as np

    from quern.operators.best import Best

    rng = np.random.default_rng(3)
    values = rng.integers(0, 6, (7, 90)) / 4  # many ties
    for ids in (rng.permutation(90), np.array([f"d{k:02}" for k in rng.permutation(90)], dtype=object)):
        best = Best(7, 4)
        for at in range(0, 90, 8):
            q, d = np.nonzero(values[:, at : at + 8] <= best.limit[:, None])
            best.add(q, values[q, d + at], ids[d + at])
        got = [tuple(r) for rows in best.rows(np.arange(7), "v") for r in rows.itertuples(index=False)]
        assert sorted(got) == sorted((q, ids[j], values[q, j]) for q in range(7) for j in sorted(range(90), key=lambda j: (values[q, j], ids[j]))[:4])


def test_bm25_equals_brute_force_and_hands_on_its_best_only(spark, monkeypatch):
    import math

    from quern.operators import lexical

    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["row", "lock", "page", "cache", "of", "b" + str(i % 9)], k=rng.randint(1, 12))) for i in range(200)}
    queries = {(1, 0): "row lock b3", (1, 1): "the cache of", (2, 0): "row lock b3", (3, 0): "nothing"}
    docs = spark.createDataFrame([*texts.items(), (998, None), (999, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(*k, q) for k, q in queries.items()], "qid long, route int, query string")
    kept, usual = [], lexical.cut
    monkeypatch.setattr(lexical, "cut", lambda df: (out := usual(df), kept.append(out.count()))[0])
    monkeypatch.setattr(lexical, "DOCUMENTS", 16)
    got = [tuple(r) for r in lexical.bm25_topk(asked, docs, 5).collect()]
    assert max(kept) <= 15  # five a wording: no row for each document and term is moved
    n, avg = 202, sum(len(t.split()) for t in texts.values()) / 202
    df = {w: sum(w in t.split() for t in texts.values()) for t in queries.values() for w in t.split()}
    part = lambda w, t: math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg))
    want = []
    for (qid, route), q in queries.items():
        scores = sorted((-round(s, 6), i) for i, t in texts.items() if (s := sum(part(w, t.split()) for w in q.split())) > 0)
        want += [(qid, route, i, -s, rank) for rank, (s, i) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)
    assert sorted(tuple(r) for r in lexical.best_matches(lexical.numbered(asked), docs, 5, block=1).select("doc_id", "score", "rank").collect()) == sorted(w[2:] for w in want if w[0] != 2)


def test_a_repeated_id_is_one_document(spark):
    from quern.operators import lexical

    docs = spark.createDataFrame([(1, "row lock"), (1, "row"), (2, "row page")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 0, "row")], "qid long, route int, query string")
    got = lexical.bm25_topk(asked, docs, 5).orderBy("rank").collect()
    idf, part = __import__("math").log((3 - 2 + 0.5) / (2 + 0.5) + 1), lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (5 / 3)))
    assert [(r.doc_id, r.score) for r in got] == [(1, round(idf * (part(2, 2) + part(2, 1)), 6)), (2, round(idf * part(1, 2), 6))]


def test_equal_wordings_are_looked_for_once(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, collection string, acl array<string>")
    q = spark.createDataFrame([(i, "row lock", ["page cache", "row lock"]) for i in range(4)], "qid long, query string, variants array<string>")
    sizes, usual = [], search.cosine_topk
    monkeypatch.setattr(search, "cosine_topk", lambda asked, *a: (sizes.append(asked.count()), usual(asked, *a))[1])
    hits = search.search(q, docs, k=2).collect()
    assert sizes == [2] and len({(r.doc_id, r.score, r.place) for r in hits}) == 2 and len(hits) == 8
    kept = evaluation.search_retention(q, docs, k=2).first()
    assert sizes == [2, 2] and kept.n == 4
    sizes.clear()
    explain.explained(q, docs, spark.createDataFrame([(1, 3)], "qid long, doc_id long"), k=2)
    assert sizes == [2]  # the scans and the search have one pass


def test_diagnosis_of_queries_whose_target_no_scan_has(spark):
    scans = spark.createDataFrame([(1, 0, "a", 0, 1.0, 0.1), (2, 0, "b", 0, 1.0, 0.1)], CAND.replace("weight double", "weight double, distance double"))
    seen = spark.createDataFrame([(1, "a")], "qid int, doc_id string")
    got = {r.qid: r.verdict for r in explain.diagnose(scans, seen, asked=spark.createDataFrame([(1,), (2,)], "qid int")).collect()}
    assert got == {1: "recalled by the original query only", 2: "not recalled by any route"}


def test_hashed_embeddings_are_sums_over_terms(spark):
    import hashlib

    rows = {r.doc_id: list(r.vec) for r in vectors.hash_embedding(spark.createDataFrame([(1, "row 数据库 row"), (2, None), (3, " ")], "doc_id long, text string"), size=16).collect()}
    want = [0.0] * 16
    for w in ("row", "row", "数据", "据库"):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        want[h % 16] += 1.0 if h // 16 % 2 == 0 else -1.0
    assert rows == {1: want}
