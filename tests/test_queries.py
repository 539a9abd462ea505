"""Rules and queries on small tables, and the registered queries against DuckDB on the smallest data."""

import time
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.operators import crawl as C
from siteloom.operators import lifecycle as L
from siteloom.operators import page_issues as R
from siteloom.operators import queries as Q
from siteloom.operators import text_stats as S
from siteloom.plans import catalogue, store, streams  # noqa: F401
from siteloom.sources import dom, sinks
from siteloom.sources.pages import parsed

DATA = "/root/testdata/sf0.001"
CHECKED = ["issue_summary", "page_parse_core", "issues_per_page", "dup_titles", "sitemap_missing", "inlinks_count", "diff_summary", "anchor_summary", "ngrams_2", "readability", "structured_data", "cron_next", "issues_tagged", "page_fields", "sitemap_parse", "hreflang_reciprocity", "amp_pairs", "custom_extractions", "crawl_fifo", "orphans", "crawl_run", "crawl_status_stream", "pages_streamed"]
#: All of the store's queries: their SQL is the test of what changes projects, crawls, schedules and diffs.
CHECKED += [n for n in catalogue.ORACLE_SQL if catalogue.QUERIES[n].__module__ == store.__name__]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "lineitem", "part", "orders", "customer", "events", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DATA)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    near = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(near, got.select(*names).collect()), key=str) == sorted(map(near, want.fetchall()), key=str)


def test_headings_and_social_flags(spark):
    page = "<title>{}</title><meta property='og:title' content=x><h1>a</h1><h3>b</h3>".format("t" * 40)
    pages = parsed(spark.createDataFrame([(1, "https://a.b/", page), (2, "https://a.b/n", None)], "page_id long, url string, html string")).withColumn("status_code", F.lit(200))
    kinds = lambda compat: {r.issue_type: r.detail for r in R.post_crawl_page_issues(pages.where("page_id = 1"), compat).collect()}
    assert kinds(False)["heading_non_sequential"] == "1-3" and "og_missing_image" in kinds(False)
    assert kinds(True)["heading_non_sequential"] == "0-1" and "missing_og_tags" in kinds(True)
    assert pages.where("page_id = 2 and title is null").count() == 1


def test_page_filters(spark):
    p = spark.createDataFrame([(i, f"https://a.b/{i}", c, "100%_x" if i == 1 else "t") for i, c in enumerate([200, 200, 301, 404, 403, None])], "page_id int, url string, status_code int, title string").withColumn("meta_description", F.lit(None).cast("string"))
    assert Q.page_filter(p, status_class="4xx").count() == 2 and Q.page_filter(p, excluded=[403]).count() == 4
    assert Q.page_filter(p, term="%_x").count() == 1 and Q.page_filter(p, status_class="9xx").count() == 6
    assert [r.page_id for r in Q.query_pages(p, sort="status_code", size=2).collect()] == [3, 4]


def test_diff_laws(spark):
    t = "crawl_id int, page_id int, url string, normalized_url string, status_code int, title string, meta_description string, indexability string, content_hash string"
    a = spark.createDataFrame([(1, 1, "u1", None, 200, "x", None, "indexable", "h"), (1, 2, "u2", None, 200, None, None, "indexable", "h")], t)
    b = spark.createDataFrame([(2, 3, "u2", None, 404, "", None, "indexable", "h"), (2, 4, "u3", None, 200, "y", None, "indexable", "h")], t)
    assert Q.new_pages(a, a).count() == 0 and Q.changed_pages(a, a).count() == 0
    assert [r.url for r in Q.new_pages(a, b).collect()] == ["u3"] and [r.changed for r in Q.changed_pages(a, b).collect()] == ["status_code"]
    kept, moved = Q.deduplicated(a.unionByName(a.withColumn("page_id", F.col("page_id") + 10)), spark.createDataFrame([(11, "x")], "page_id int, i string"))
    assert kept.count() == 2 and moved.first().page_id == 1


def test_text_measures(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma alpha")], "id int, text string")
    assert S.keyword_totals(d, F.col("text"), 2).first()[:] == (4, 3)
    assert {r.phrase: r["count"] for r in S.keyword_counts(d, F.col("text"), 2).collect()} == {"alpha beta": 1, "beta gamma": 1, "gamma alpha": 1}
    w = spark.createDataFrame([("cat",), ("reading",), ("available",)], "w string").select(T.syllables(F.col("w")).alias("n"))
    assert [r.n for r in w.collect()] == [1, 2, 4]
    r = S.readability(spark.createDataFrame([("The cat sat. The dog ran. It was fun.",), ("",)], "t string"), F.col("t")).collect()
    assert r[0].sentence_count == 3 and r[0].flesch_reading_ease > 80 and r[0].reading_level == "Easy" and r[1].words == 0
    assert [x[0] for x in spark.createDataFrame([(100.0,), (700.0,), (3000.0,)], "x double").select(T.response_score(F.col("x"))).collect()] == [100, 70, 20]


def test_frontier_and_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "source string, target string")
    assert rows(C.frontier_levels(spark.createDataFrame([("a",)], "url string"), edges)) == [("a", 0), ("b", 1), ("c", 1)]
    assert C.frontier_levels(spark.createDataFrame([("a",)], "url string"), edges, max_urls=2).count() == 2
    k = spark.createDataFrame([("1-gram", 'a "b", c', 3, 0.5)], "gram_type string, phrase string, count int, frequency double")
    sinks.write_csv(k, "keywords", str(tmp_path / "k"))
    assert rows(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "k"))) == [("1-gram", 'a "b", c', "3", "0.5")]
    pages = spark.createDataFrame([(i, f"https://a.b/{i}?x=1&y", 200, "indexable") for i in range(5)], "page_id long, url string, status_code int, indexability string")
    files = sinks.sitemap_files(sinks.sitemap_blocks(pages, per_file=2)).collect()
    assert sorted(f.urls for f in files) == [1, 2, 2] and "&amp;y" in files[0].xml


def test_whole_link_graph(spark, tmp_path):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["orphans_all_links"]).fetchall()
    assert rows(catalogue.QUERIES["orphans_all_links"](spark, DATA).select("url")) == sorted(want, key=str)
    # Part 7 is linked from source 3 alone, which is no multiple of 50; only part 8 has no link.
    spark.createDataFrame([(3, 7, 1, "A", "O")], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, "a"), (8, "b")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert rows(catalogue.QUERIES["orphans_all_links"](spark, str(tmp_path))) == [("/p/8",)]
    links = {}
    for s, t in con.execute("SELECT l_orderkey, l_partkey FROM lineitem").fetchall():
        links.setdefault(s, set()).add(t)
    depth, level = {1: 0}, {1}
    while level:
        level = {t for s in level for t in links.get(s, ())} - set(depth)
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    assert rows(catalogue.QUERIES["crawl_bfs_all_levels"](spark, DATA)) == sorted(((str(u), k) for u, k in depth.items()), key=str)
    assert max(depth.values()) > 4 or len(depth) > 50


def test_pages_with_open_tags_take_linear_time():
    begin = time.time()
    for hard in ("<a " * 200_000, "<div>" * 50_000 + "</x>" * 50_000, '<a "' * 100_000, "<!" * 200_000, "<div>" * 20_000 + "<p>a" * 20_000, "<script>" + "</script " * 50_000):
        dom.parse(hard)
    assert time.time() - begin < 8
    assert dom.parse("<p>one<a href='x").text() == "one<a href='x"


def test_errors_of_the_lifecycle(spark):
    table = spark.createDataFrame([(1, "crawling"), (2, "completed")], "crawl_id long, status string")
    assert L.completed(table, 2).count() == 1
    for n in (1, 7):
        with pytest.raises(ValueError):
            L.completed(table, n)
    none = spark.createDataFrame([], "schedule_id long, project_id long, start_url string, cron_expression string, enabled boolean, next_run_at timestamp_ntz, created_at timestamp_ntz")
    projects = spark.createDataFrame([(1,)], "project_id long")
    good = {"project_id": 1, "start_url": "https://a", "cron_expression": "0 3 * * *"}
    assert L.new_schedule(none, projects, datetime(2024, 1, 1), **good).count() == 1
    for bad in ({"project_id": 2}, {"start_url": " "}, {"settings": "[1]"}, {"cron_expression": "x"}):
        with pytest.raises(ValueError):
            L.new_schedule(none, projects, datetime(2024, 1, 1), **(good | bad))


def test_breadth_first_levels_by_hand(spark):
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("2", "4"), ("9", "1"), ("4", None)], "source string, target string")
    got = C.frontier_levels(spark.createDataFrame([("1",)], "url string"), edges, max_depth=2**31 - 1)
    assert {r.url: r.depth for r in got.collect()} == {"1": 0, "2": 1, "3": 2, "4": 2}


def test_pages_that_share_an_address(spark):
    t = "page_id int, url string, normalized_url string, status_code int, title string, meta_description string, indexability string, content_hash string"
    at = lambda *rs: spark.createDataFrame([(i, u, u, 200, x, None, "indexable", h) for i, u, x, h in rs], t)
    a, b = at((1, "u", "x", "h1"), (2, "u", "y", "h2"), (3, "v", "z", "h3")), at((1, "u", "x", "h1"), (2, "u", "x", "h4"), (3, "v", "z", "h5"))
    assert [tuple(r) for r in Q.diff_summary(a, b, fields=("title",)).collect()] == [(3, 3, 0, 0, 2)]
    got = Q.changed_pages(a, b, fields=("title",)).select("url", "old_title", "new_title", "changed")
    assert rows(got) == [("u", "y", "x", "title")] * 2
    assert Q.diff_summary(a, b).first().changed_pages == Q.changed_pages(a, b).count() == 4


def test_repeated_links_to_broken_targets(spark):
    pages = spark.createDataFrame([("/p", "/p", None, 404)], "url string, normalized_url string, final_url string, status_code int").withColumns({"page_id": F.lit(1), "crawl_id": F.lit(1)})
    links = spark.createDataFrame([(1, 1, "/p", "/p"), (1, 1, "/p", "/p"), (1, 2, "/P", "/p"), (2, 1, "/q", "/q")], "source_id int, position int, target_url string, target_normalized_url string")
    assert rows(Q.broken_targets(pages, links)) == [("/P", 1), ("/p", 2)]


def test_entries_of_sitemaps_outside_the_tree(spark):
    from siteloom.sources import landing

    maps = spark.createDataFrame([("root", "<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>u</loc></url></urlset>"), ("b", "<urlset><url><loc>u</loc><priority>1</priority></url></urlset>")], "sitemap string, xml string")
    under = landing.sitemaps_under(maps, "root")
    assert rows(landing.sitemap_entries(under).select("sitemap", "loc")) == [("a", "u")] and rows(landing.sitemap_tree(maps, "root")) == [("u",)]


@pytest.mark.parametrize("name", ["page_parse_core", "dup_titles", "issues_per_page", "urls_export", "diff_changed", "diff_summary", "sitemap_parse", "pages_streamed"])
def test_cut_references_and_shared_addresses(spark, tmp_path, name):
    """Titles that end within a reference, and addresses that several pages share, within and across what is told apart."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id > 3 THEN lag(url, 3) OVER (ORDER BY page_id) ELSE url END AS url,
        CASE WHEN page_id % 4 < 2 THEN replace(html, '</title>', ' of &amp; &amp</title>') ELSE html END AS html FROM '{DATA}/pages.parquet') TO '{tmp_path}/pages.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)), con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_keyword_shares_at_the_half(spark, tmp_path):
    """23 of 147 words: 0.156462585, whose scaled double lies below the half."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 1::BIGINT AS doc_id, repeat('often ', 23) || (SELECT string_agg('w' || range, ' ') FROM range(100, 224)) AS text) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["keywords_export"]).fetchall()
    assert rows(catalogue.QUERIES["keywords_export"](spark, str(tmp_path))) == sorted(want, key=str) and ("unigram", "often", "23", "0.15646258") in want


def test_a_parse_sends_a_few_pages_at_a_time(spark):
    """What a task holds is bounded, whatever the session's limits are, and trees leave without the collector."""
    import gc

    from siteloom.sources import pages as P

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    one = parsed(spark.range(0, 1200, 1, 1).selectExpr("id as page_id", "concat('https://a.b/', id) as url", "concat('<title>', id, '</title>') as html"))
    sizes = one.mapInArrow(lambda bs: (b.select(["page_id"]).slice(0, 1) for b in bs), "page_id long")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert sizes.count() >= 3 and one.where("title = page_id").count() == 1200
    gc.collect()
    gc.disable()
    try:
        P.parse_page("https://a.b/", "<p><a href=x>y</a>" * 50)
        assert not any(type(o) is dom.Node for o in gc.get_objects())
    finally:
        gc.enable()


def test_terms_and_phrases_are_shuffled_once(spark):
    """Rows of terms are made once for weights and document counts; stop words are looked up in a set; phrases are not gathered."""
    d = spark.createDataFrame([(1, "red red blue"), (2, "blue the sea"), (3, None)], "doc_id long, text string")
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    weights = S.tfidf(d, "doc_id", F.col("text"))
    assert plan(weights).count("count(1)") <= 3 and " INSET " in plan(weights) and {(r.id, r.term) for r in weights.collect()} == {(1, "red"), (1, "blue"), (2, "blue"), (2, "sea")}
    phrases = S.keyword_counts(d, F.col("text"), 2)
    assert "zip_with" not in plan(phrases) and rows(phrases) == [("blue sea", 1), ("red blue", 1), ("red red", 1)]


def test_similar_pairs_by_blocks():
    """Every two blocks meet, terms are dense or not, and products are added some at a time: the same as all pairs."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    most, S.PRODUCTS = S.PRODUCTS, 50
    try:
        docs = [(k, np.sort(rng.choice(30, 6, replace=False)) + S.DENSE - 8, rng.random(6)) for k in range(60)]
        whole = np.zeros((60, S.DENSE + 30))
        for k, no, w in docs:
            whole[k, no] = w
        want = {(a, b): s for a in range(60) for b in range(a + 1, 60) if (s := whole[a] @ whole[b]) >= 0.35}
        got = {}
        for i in range(3):
            for j in range(i, 3):
                cell = [r for r in docs if r[0] % 3 in (i, j)]
                table = pa.table({"id": [r[0] for r in cell], "no": pa.array([list(r[1]) for r in cell], pa.list_(pa.int64())), "w": pa.array([list(r[2]) for r in cell], pa.list_(pa.float64())), "block": [r[0] % 3 for r in cell], "i": [i] * len(cell), "j": [j] * len(cell)})
                for r in S._block_pairs(table, 0.35).to_pylist():
                    assert (r["a"], r["b"]) not in got
                    got[r["a"], r["b"]] = r["similarity"]
        assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    finally:
        S.PRODUCTS = most


def test_stored_text_of_blank_and_missing_texts(spark, tmp_path):
    """Blank texts, texts that are missing, spaces of any kind at the ends, ids below 0: as the SQL has them."""
    texts = ["", "  ", None, " a ", " b　 ", "\tc\n", "d \n", " ", "e​", "[f]", "g  h"]
    spark.createDataFrame([(k - 12, texts[k % 11]) for k in range(99)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["stored_text"]).fetchall()
    assert sorted(rows(store.stored_text(spark, str(tmp_path))), key=str) == sorted(want, key=str) and len(want) == 99


def made_texts(spark, n=60):
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(25)]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9)) + [f"only{k}"] * (k % 4 == 0))) for k in range(n)] + [(n, None), (3, "again w1 w2"), (None, "w1 w3")]
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_similar_pairs_shuffle_no_copies(spark, monkeypatch):
    """Parts of documents meet in tasks that read them where they are stored; rows that share an id are one document."""
    monkeypatch.setattr(S, "BLOCK", 13)
    docs = made_texts(spark)
    unit = {}
    for r in S.unit(S.tfidf(docs, "doc_id", F.col("text"))).where("id is not null").collect():
        unit.setdefault(r.id, {})[r.term] = r.w
    ids = sorted(k for k in unit if k != 3)
    want = {(a, b): round(s, 9) for a in ids for b in ids if a < b and (s := sum(w * unit[b].get(t, 0) for t, w in unit[a].items())) >= 0.35}
    found = S.similar_pairs(S.text_documents(docs, "doc_id", F.col("text")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = [(r.a, r.b, round(r.similarity, 9)) for r in found.collect()]
    assert {(a, b): s for a, b, s in got if 3 not in (a, b)} == want and len(want) > 100 and len({x[:2] for x in got}) == len(got) and any(3 in x[:2] for x in got)


def test_taken_documents_meet_no_more_leaders():
    """Leaders come from the smallest on; a document that has one is not compared again, and no pack is read for none."""
    import numpy as np

    def side(ids, terms):
        return S._side(np.array(ids), np.ones(len(ids), int), np.array(terms), np.ones(len(ids)))

    def packs():
        yield side([1, 2], [5, 6])
        yield side([3, 4], [7, 5])
        raise AssertionError("all are taken")

    found = [r for b in S._met(side([10, 11, 12], [5, 7, 6]), packs(), 0.35) for r in b.to_pylist()]
    assert sorted((r["id"], r["leader"], r["similarity"]) for r in found) == [(10, 1, 1.0), (11, 3, 1.0), (12, 2, 1.0)]


def test_similarity_at_the_limit_is_decided_in_double_precision():
    """Products in single precision can't tell which documents are similar to just the least, those in double precision do."""
    import numpy as np

    rng = np.random.default_rng(3)
    no = np.sort(rng.permuted(np.tile(np.arange(400), (80, 1)), axis=1)[:, :60], axis=1)
    w = rng.random((80, 60))
    w /= np.sqrt((w * w).sum(1, keepdims=True))
    docs = S._side(np.arange(80), np.full(80, 60), no.reshape(-1), w.reshape(-1))
    x, y = (v.reshape(-1) for v in np.divmod(np.arange(6400), 80))
    dots = S._exact(docs, docs, x, y)
    assert np.allclose(dots.reshape(80, 80), S._dots(docs, docs))
    for least in np.sort(dots)[3000:3010]:
        assert (S._similar(docs, docs, least).reshape(-1) == (dots >= least)).all()


def test_cluster_terms_by_texts(spark):
    """Sums of hashed terms, named where they may be among the largest: the same keywords as by weights, ties by term."""
    docs = made_texts(spark).dropDuplicates(["doc_id"])
    documents, weights = S.text_documents(docs, "doc_id", F.col("text")), S.stored_tfidf(docs, "doc_id", F.col("text"))
    members = S.grouped(S.leading(documents))
    assert rows(members) == rows(S.grouped(S.leading(weights))) and members.count() > 20
    want = rows(S.cluster_terms(members, weights, 3))
    assert rows(S.cluster_terms(members, documents, 3)) == want and len(want) > 3
    plan = S.cluster_terms(members, documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "h#" in plan and plan.count("Join") == 1


def test_clusters_in_many_rounds(spark, monkeypatch):
    """Parts of two documents, settled in several rounds, give the clusters of a pass from document to document; so does no document."""
    monkeypatch.setattr(S, "BLOCK", 4)
    docs = made_texts(spark, 40).dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    documents = S.text_documents(docs, "doc_id", F.col("text"))
    pairs = {(r.a, r.b): r.similarity for r in S.similar_pairs(documents).collect()}
    want = {}
    for k in range(41):
        if k not in want:
            want |= {b: (k, round(s, 9)) for (a, b), s in pairs.items() if a == k and b not in want}
    got = S.leading(documents).collect()
    assert {r.id: (r.leader, round(r.similarity, 9)) for r in got} == want and len(got) == len(want) > 10
    none = S.text_documents(docs.where("false"), "doc_id", F.col("text"))
    assert S.leading(none).count() == S.similar_pairs(none).count() == 0


def test_clusters_export_of_odd_texts(spark, tmp_path):
    """Empty, missing and equal texts, and terms of one document among the largest: the rows of its SQL, from terms known by hash."""
    made_texts(spark, 40).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame([(90, ""), (91, "x1 x2 x3"), (92, "x1 x2 x3"), (93, "x1 x2 y9")], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["clusters_export"]).fetchall()
    found = store.clusters_export(spark, str(tmp_path))
    assert rows(found) == sorted(want, key=str) and len(want) > 10
    assert "h#" in found._jdf.queryExecution().optimizedPlan().toString()
