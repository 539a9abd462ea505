"""Clusters, crawl order, ranks, streams and stored tables: each against a plain version of the same."""

import datetime as dt
import random
from collections import Counter, deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siteloom.functions import lineage
from siteloom.operators import crawl as C
from siteloom.operators import queries as Q
from siteloom.operators import registry
from siteloom.operators import text_stats as S
from siteloom.sources import extraction, landing, sinks, stored
from siteloom.streaming import status, store


def test_parallel_leaders_equal_the_sequential_pass(spark):
    rng = random.Random(6)
    for n, edges in ((30, 20), (40, 160), (13, 12)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))): rng.random() for _ in range(edges)} if edges != 12 else {(k, k + 1): 0.5 for k in range(12)}
        taken, want = {}, {}
        for a in range(n):
            if a in taken:
                continue
            mine = [b for b in range(a + 1, n) if (a, b) in pairs and b not in taken]
            for b in mine:
                taken[b] = a
                want[b] = (a, round(pairs[a, b], 3))
            if mine:
                want[a] = (a, 1.0)
        frame = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, similarity double")
        got = S.clusters(frame, spark.range(n)).collect()
        assert {r.id: (r.leader, round(r.score, 3)) for r in got} == want and len(got) == len(want)
    assert S.clusters(frame.where("false"), spark.range(3)).count() == 0


def test_leaders_by_blocks_equal_the_sequential_pass(spark, monkeypatch):
    """Documents are settled block by block, each against the leaders before it: no table of all pairs is made."""
    rng = random.Random(8)
    texts = [(k * 3, " ".join(rng.choices(["red", "blue", "green", "sea", "sky", "sun", "moon"], k=rng.randint(0, 5)))) for k in range(40)] + [(200, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    weights = S.stored_tfidf(docs, "doc_id", F.col("text"))
    assert {(r.id, r.term, round(r.weight, 9)) for r in weights.collect()} == {(r.id, r.term, round(r.weight, 9)) for r in S.tfidf(docs, "doc_id", F.col("text")).collect()}
    sims = {(r.a, r.b): r.similarity for r in S.similar_pairs(S.unit(weights)).collect()}
    want = {}
    for k in sorted(k for k, _ in texts):
        if k not in want:
            want |= {b: (k, round(s, 9)) for (a, b), s in sorted(sims.items()) if a == k and b not in want}
    monkeypatch.setattr(S, "BLOCK", 9)
    monkeypatch.setattr(S, "similar_pairs", None)
    got = S.leading(weights).collect()
    assert {r.id: (r.leader, round(r.similarity, 9)) for r in got} == want and len(got) == len(want) and len({a for a, _ in want.values()}) > 2
    assert S.leading(weights.where("false")).count() == 0


def plain_crawl(seeds, links, max_depth, max_urls, blocked, in_scope):
    """The queue of a crawl that takes one page after the other."""
    out, queue = {}, deque()
    for u, _ in sorted(((u, p) for u, p in seeds if u is not None), key=lambda x: (x[1], x[0])):
        if u not in out and len(out) < max_urls:
            out[u] = (0, len(out), not blocked(u))
            queue.append(u)
    while queue:
        u = queue.popleft()
        if not out[u][2]:
            continue
        for t, _ in sorted(links.get(u, []), key=lambda x: (x[1], x[0])):
            if in_scope(t) and t not in out and out[u][0] < max_depth and len(out) < max_urls:
                out[t] = (out[u][0] + 1, len(out), not blocked(t))
                queue.append(t)
    return out


@pytest.mark.parametrize("max_urls", [1, 23])
def test_crawl_order_is_that_of_a_queue(spark, max_urls):
    rng = random.Random(max_urls)
    links = {str(k): [(str(rng.randrange(60)), p) for p in range(rng.randint(0, 5))] for k in range(60)}
    frame = spark.createDataFrame([(s, t, p) for s, ts in links.items() for t, p in ts], "source string, target string, position int").repartition(3)
    seeds = [("0", 0), ("5", 2), ("5", 1), (None, 0), ("9", 7)]
    got = C.crawl_order(
        spark.createDataFrame(seeds, "url string, position int"), frame, max_depth=4, max_urls=max_urls,
        blocked=lambda u: u.where("cast(url as int) % 7 = 3"), in_scope=lambda c: c.cast("int") % 11 != 5)
    want = plain_crawl(seeds, links, 4, max_urls, lambda u: int(u) % 7 == 3, lambda u: int(u) % 11 != 5)
    assert {r.url: (r.depth, r.place, r.crawled) for r in got.collect()} == want
    assert C.crawl_order(spark.createDataFrame([], "url string, position int"), frame, max_depth=2, max_urls=5).count() == 0


def test_ranks_and_slices(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "v int, k int").repartition(7)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    order = [F.col("v").desc(), F.col("k")]
    assert [(r.v, r.k) for r in sorted(lineage.ranked(frame, order).collect(), key=lambda r: r["rank"])] == want
    for offset, size in ((0, 10), (1490, 40), (2990, 50), (3000, 5)):
        assert [tuple(r) for r in lineage.slice_of(frame, order, offset, size).collect()] == want[offset : offset + size]


def plain_status(events):
    state = (-1, -1, "created", 0, 0, 0, 0, 0, 0)
    for at, seq, kind, told in sorted(events):
        state = status.applied(state, seq, (kind, at, *told))
    return state[2:]


def test_a_level_goes_to_the_links(spark, monkeypatch):
    """While a level is small the links are not shuffled for it; a large one meets them by a shuffle, with the same result."""
    edges = spark.createDataFrame([(str(k), str(t)) for k in range(40) for t in (k + 1, k // 2)] + [("3", None)], "source string, target string")
    plans = []

    def cut(frame, name):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return lineage.cut(frame)

    seeds = spark.createDataFrame([("5",), (None,)], "url string")
    few = {(r.url, r.depth) for r in C.frontier_levels(seeds, edges, max_depth=2**31 - 1, cut=cut).collect()}
    assert len(few) == 41 and ("40", 35) in few and ("0", 3) in few
    assert sum("leftHint=(strategy=broadcast)" in p or "rightHint=(strategy=broadcast)" in p for p in plans) >= 36
    monkeypatch.setattr(C, "SENT", 0)
    assert {(r.url, r.depth) for r in C.frontier_levels(seeds, edges, max_depth=3).collect()} == {x for x in few if x[1] <= 3}
    assert {(r.url, r.depth) for r in C.frontier_levels(seeds, edges, max_depth=9, max_urls=3).collect()} == {("5", 0), ("2", 1), ("6", 1)}


def test_a_batch_of_events_is_one_message():
    """The state store gets a crawl's events of a batch at once, and is asked for them once; of a repeated number the last stands."""
    import pandas as pd

    class Store:
        def __init__(self):
            self.calls, self.held, self.value, self.timers = 0, [], None, []

        def getValueState(self, *_):
            return type("V", (), {"exists": lambda v: self.value is not None, "get": lambda v: self.value, "update": lambda v, x: setattr(self, "value", x)})()

        def getListState(self, *_):
            def told(change):
                self.calls += 1
                return change()

            return type("L", (), {"appendList": lambda v, x: told(lambda: self.held.extend(x)), "get": lambda v: told(lambda: iter(list(self.held))), "put": lambda v, x: told(lambda: setattr(self, "held", list(x))), "clear": lambda v: told(self.held.clear)})()

        def registerTimer(self, at):
            self.timers.append(at)

    kept, crawl = Store(), status._Status()
    crawl.init(kept)
    at = lambda ms: pd.Timestamp(ms, unit="ms")
    rows = [(1, k, at(10 * k), "progress", k, None, None, None) for k in range(2, 500)] + [(1, 1, at(5), "start", None, None, None, None), (1, 499, at(4990), "progress", 7, None, 3, None)]
    frame = pd.DataFrame(rows, columns=["crawl_id", "seq", "ts", "kind", *status.COUNTERS])
    assert list(crawl.handleInputRows((1,), iter([frame]), None)) == [] and kept.timers == [4990] and kept.calls == 1
    timer = lambda ms: type("T", (), {"getExpiryTimeInMs": lambda t: ms})()
    (first,) = crawl.handleExpiredTimer((1,), None, timer(100))
    assert first.iloc[0].tolist() == [1, 10, 100, "crawling", 10, 0, 0, 0, 10, 0] and len(kept.held) == 489
    (last,) = crawl.handleExpiredTimer((1,), None, timer(4990))
    assert last.iloc[0].tolist() == [1, 499, 4990, "crawling", 7, 0, 3, 0, 499, 0] and kept.held == [] and kept.calls == 5


def test_crawl_status_over_a_stream(spark, tmp_path):
    """Events out of order within a file, repeated in the next one, and a restart from the checkpoint in between."""
    rng, start = random.Random(9), dt.datetime(2024, 1, 1)
    kinds = ["start", "pause", "resume", "progress", "progress", "progress", "stop", "complete"]
    rows = [(c, s, start + dt.timedelta(seconds=60 * s + c), "start" if s == 0 else rng.choice(kinds[: 6 if s < 18 else 8]), *(rng.randrange(100) if rng.random() < 0.8 else None for _ in range(4))) for c in range(5) for s in range(24)]
    late = [r for r in rows if r[1] >= 12]
    early = [r for r in rows if r[1] < 14]
    end = [(99, 0, start + dt.timedelta(days=1), "start", None, None, None, None)]

    def run():
        stream = spark.readStream.schema(status.INPUT).parquet(str(tmp_path / "in"))
        with status.with_store(spark):
            status.statuses(stream, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for part in (early, late, end):
        rng.shuffle(part)
        spark.createDataFrame(part, status.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = {r.crawl_id: (r.status, r.crawled, r.queued, r.issues, r.links, r.applied, r.refused) for r in status.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    for c in range(5):
        want = plain_status([(int(r[2].replace(tzinfo=dt.timezone.utc).timestamp() * 1000), r[1], r[3], r[4:]) for r in rows if r[0] == c])
        assert got[c] == want
    assert {r.crawl_id for r in status.active(spark.read.parquet(str(tmp_path / "out"))).collect()} == {c for c, s in got.items() if s[0] not in status.ENDED}


def fetches(spark, rows):
    told = [(c, p, u, None, 200, None, "text/html", None, 10.0, 0, h, None, 0, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for c, p, u, h, m in rows]
    return spark.createDataFrame(told, landing.FETCH)


def page(title, links):
    return f"<html><head><title>{title}</title></head><body><h1>x</h1>" + "".join(f'<a href="https://s.test/{k}">{k}</a>' for k in links) + "</body></html>"


def told(spark, out):
    now = store.current(spark, out)
    if not now:
        return None
    return (
        Counter((r.crawl_id, r.url, r.title, r.page_id) for r in now["pages"].collect()), Counter((r.crawl_id, r.source_url, r.target_url) for r in now["links"].collect()),
        Counter((r.crawl_id, r.url, r.issue_type) for r in now["issues"].collect()))


def test_streamed_tables_survive_replays(spark, tmp_path):
    first = fetches(spark, [(1, 1, "https://s.test/a", page("one", "bc"), 0), (1, 2, "https://s.test/b", page("", "a"), 0), (2, 3, "https://s.test/a", page("other crawl", ""), 0)])
    second = fetches(spark, [(1, 4, "https://s.test/a", page("two", "d"), 5), (1, 5, "https://s.test/b", page("older", "z"), -5), (1, 6, "https://s.test/a", page("twice in a batch", "q"), 4)])
    once, again, half = (str(tmp_path / n) for n in ("once", "again", "half"))
    for out in (once, again, half):
        store.write_batch(first, 0, out)
    store.write_batch(second, 1, once)
    for _ in range(2):
        store.write_batch(second, 1, again)
    # Stopped after its pages were written: nothing of it is seen, and the next try replaces it.
    first.limit(1).write.parquet(f"{half}/pages/1")
    before = told(spark, half)
    assert sum(before[0].values()) == 3
    store.write_batch(second, 1, half)
    assert told(spark, once) == told(spark, again) == told(spark, half)
    pages, links, issues = told(spark, once)
    assert pages == Counter([(1, "https://s.test/a", "two", 4), (1, "https://s.test/b", None, 2), (2, "https://s.test/a", "other crawl", 3)])
    assert links == Counter([(1, "https://s.test/a", "https://s.test/d"), (1, "https://s.test/b", "https://s.test/a")])
    assert issues[1, "https://s.test/b", "missing_title"] == 1 and not issues[1, "https://s.test/a", "missing_title"]
    assert told(spark, str(tmp_path / "nothing")) is None


def test_ingest_reads_files_as_they_come(spark, tmp_path):
    rows = [(1, k, f"https://s.test/{k % 6}", page(f"t{k}", "ab"), k) for k in range(12)]
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    stream = lambda: spark.readStream.schema(landing.FETCH).option("maxFilesPerTrigger", 1).parquet(source)
    for part in (rows[:5], rows[5:]):
        fetches(spark, part).coalesce(1).write.mode("append").parquet(source)
        store.ingest(stream(), out, cp).awaitTermination()
    store.ingest(stream(), out, cp).awaitTermination()  # nothing new
    pages, links, _ = told(spark, out)
    assert pages == Counter((1, f"https://s.test/{k % 6}", f"t{k}", k) for k in range(6, 12)) and sum(links.values()) == 12


def test_clearing_a_crawl_leaves_the_others_files(spark, tmp_path):
    rows = [(c, 10 * c + k, f"https://s.test/{k}", page(f"t{k}", "ab"), 0) for c in (1, 2, 3) for k in range(3)]
    out, target = str(tmp_path / "out"), str(tmp_path / "target")
    store.write_batch(fetches(spark, rows), 0, out)
    store.compact(spark, out, target)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(target).rglob("*.parquet") if "crawl_id=2" not in str(p)}
    before = files()
    store.clear_crawl(spark, target, 2)
    assert files() == before and {r.crawl_id for r in spark.read.parquet(f"{target}/pages").collect()} == {1, 3}
    # A partition filter reads one crawl's folder, and two columns of it.
    plan = spark.read.parquet(f"{target}/pages").where("crawl_id = 1").select("url", "title")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(crawl_id" in text and "ReadSchema: struct<url:string,title:string>" in text
    # A crawl that is written again replaces its own partition only.
    store.write_batch(fetches(spark, [(3, 77, "https://s.test/new", page("n", ""), 9)]), 1, str(tmp_path / "out2"))
    others = {p: t for p, t in files().items() if "crawl_id=3" not in p}
    store.compact(spark, str(tmp_path / "out2"), target)
    assert {p: t for p, t in files().items() if "crawl_id=3" not in p} == others
    assert {r.url for r in spark.read.parquet(f"{target}/pages").where("crawl_id = 3").collect()} == {"https://s.test/new"}
    crawls = spark.createDataFrame([(1, 7, 3), (2, 7, 3), (3, 8, 3)], "crawl_id long, project_id long, url_count long")
    store.clear_project(spark, target, crawls, 7)
    assert {r.crawl_id for r in spark.read.parquet(f"{target}/pages").collect()} == {3}
    pages = spark.createDataFrame([(1, 1), (2, 2)], "page_id long, crawl_id long")
    after = Q.cleared(2, crawls, pages=pages, issues=spark.createDataFrame([(1,), (2,)], "page_id long"))
    assert [r.url_count for r in after["crawls"].orderBy("crawl_id").collect()] == [3, 0, 3] and after["pages"].count() == after["issues"].count() == 1


def test_reports_tell_rows_and_bytes(spark, tmp_path):
    frame = spark.range(7).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("url"), F.lit('a "b", c').alias("title"))
    path, rows, size = sinks.exported(frame, "urls", str(tmp_path / "urls"), single=True)
    file = next(Path(path).glob("part-*.csv"))
    assert rows == 7 and size == file.stat().st_size
    assert spark.read.option("header", True).option("escape", '"').csv(path).where("title = 'a \"b\", c'").count() == 7


def test_every_issue_type_has_its_own_texts(spark):
    rows = registry.definitions(spark).collect()
    assert len(rows) == 63 and len({r.explanation for r in rows}) == len({r.recommendation for r in rows}) == 63
    assert all(len(r.explanation) > 30 and len(r.recommendation) > 20 for r in rows)
    assert registry.definition("some_new_type")[1:4] == ("Some new type", "warning", "technical")


def plain_allowed(rules, path):
    best = (0, 0, True)
    for k, (allow, pattern) in enumerate(rules):
        if pattern and (pattern == "/" or path.lower().startswith(pattern.lower())) and (len(pattern), -k) > best[:2]:
            best = (len(pattern), -k, allow)
    return best[2]


def test_robots_equal_a_plain_pass_and_join_by_equality(spark):
    rng = random.Random(3)
    some = lambda n: "/" + "".join(rng.choice("aB/") for _ in range(rng.randint(0, n)))
    hosts = {f"h{k}": [(rng.random() < 0.5, some(4)) for _ in range(rng.randint(0, 12))] for k in range(8)}
    robots = spark.createDataFrame([(h, "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p} # why" for a, p in rs)) for h, rs in hosts.items()], "host string, text string")
    urls = [(f"u{k}", rng.choice([*hosts, "unknown"]), some(8) if k % 20 else None) for k in range(600)]
    out = landing.robots_allowed(spark.createDataFrame(urls, "url string, host string, path string"), landing.robots_rules(robots))
    got = {r.url: r.allowed for r in out.collect()}
    assert got == {u: plain_allowed(hosts.get(h, []), p or "/") for u, h, p in urls}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if " Join " in line]
    assert len(joins) == 3 and all("=" in line and "with(" not in line.lower() for line in joins)


def test_stored_parse_is_pruned_and_takes_new_columns(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    rows = spark.createDataFrame([(c, 10 * c + k, f"https://s.test/{c}/{k}", page(f"t{k}", "ab")) for c in (1, 2) for k in range(3)] + [(2, 99, "https://s.test/none", None)], "crawl_id long, page_id long, url string, html string")
    path = str(tmp_path / "parse")
    schema = stored.write_parse(rows, path)
    newer = StructType([*schema.fields, StructField("reading_level", StringType())])
    got = stored.read_parse(spark, path, newer).where("crawl_id = 2").select("url", "title", "reading_level")
    assert {(r.url, r.title, r.reading_level) for r in got.collect()} == {(f"https://s.test/2/{k}", f"t{k}", None) for k in range(3)} | {("https://s.test/none", None, None)}
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(crawl_id" in text and "ReadSchema: struct<url:string,title:string,reading_level:string>" in text
    files = lambda c: {str(p): p.stat().st_mtime_ns for p in Path(path, f"crawl_id={c}").glob("*.parquet")}
    before = files(1)
    stored.write_parse(rows.where("crawl_id = 2").limit(1), path)
    assert files(1) == before and stored.read_parse(spark, path).groupBy("crawl_id").count().where("count = 1").count() == 1
    # One parse serves until the files change.
    table = str(tmp_path / "pages.parquet")
    rows.drop("crawl_id").write.parquet(table)
    first, again = stored.parse_of(spark, table), stored.parse_of(spark, table)
    assert first.inputFiles() == again.inputFiles() and first.count() == 7
    rows.drop("crawl_id").limit(2).write.mode("overwrite").parquet(table)
    assert stored.parse_of(spark, table).count() == 2


def test_extractions_by_crawl(spark):
    pages = spark.createDataFrame([(1, 1, "<h1> a  b </h1>" + "<i>x</i>" * 30), (2, 1, None), (3, 2, "<h1>c</h1>"), (4, 3, "<h1>d</h1>")], "page_id long, crawl_id long, html string")
    schema = "rule_id long, crawl_id long, name string, rule_type string, selector string, attribute string, active boolean"
    rules = spark.createDataFrame([(1, 1, "head", "css", "h1", None, True), (2, 1, "many", "css", "i", None, True), (3, 1, "bad", "css", "h1[", None, True), (4, 2, "odd", "sql", "x", None, True), (5, 2, "off", "css", "h1", None, False)], schema)
    got = {(r.page_id, r.rule_id): r for r in extraction.extractions(pages, rules).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (3, 4)}
    assert got[1, 1].value == "a b" and got[1, 2].match_count == 20 and len(got[1, 2]["values"]) == 20
    assert got[1, 3].error and got[3, 4].error and got[1, 3].match_count == 0
    # A crawl without rules takes those of its project's latest crawl that has some.
    crawls = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 3)], "crawl_id long, project_id long, created_at long")
    copied = C.rules_for_crawl(rules, crawls, 3)
    assert {(r.crawl_id, r.name) for r in copied.collect()} == {(3, "odd")}
    assert {r.rule_id for r in extraction.extractions(pages, copied).collect()} == {4}
    assert [r.rule_id for r in C.listed_rules(rules.withColumn("created_at", F.col("rule_id"))).collect()] == [4, 3, 2, 1, 5]
    assert extraction.extractions(pages, rules.where("false")).count() == 0
