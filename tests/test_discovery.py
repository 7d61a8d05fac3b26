"""Probes, suffix rules, turns and the discovery driver on small rows, against plain versions."""

import random

from pyspark.sql import functions as F

from provenia.operators import dedup, discovery, hosts, probing, volumes


def test_probes_go_on_with_open_rows_only(spark):
    """Answers by URL and round; a row that has a status is not asked again."""
    script = {
        "http://a.org/1": [(503, None), (429, None), (200, None)], "http://a.org/2": [(None, "timeout")] * 3, "http://a.org/3": [(500, None), (None, "connection")],
        "http://a.org/4": [(429, None)] * 3, "http://a.org/5": [(204, None)], "http://a.org/6": [(500, None), (None, "timeout"), (None, "timeout")], "http://a.org/7": [(410, None)],
    }
    said = spark.createDataFrame([(u, i, c, f) for u, tries in script.items() for i, (c, f) in enumerate(tries, 1)], "url string, n int, code int, failure string")
    asked = []

    def answer(still, number):
        asked.append({r.url for r in still.select("url").collect()})
        told = still.join(said.where(F.col("n") == number).drop("n"), "url")
        return told.withColumn("final_url", F.col("url")).withColumn("body", F.lit("fine")).withColumn("retry_after", F.when(F.col("url").endswith("4"), 5.0))

    urls = spark.createDataFrame([(u,) for u in [*script, "file:///x", None, "http://a.org/1"]], "url string")
    got = {r.url: r for r in probing.probe(urls, answer).collect()}
    assert probing.probe(urls, answer).count() == 10
    status = {u and u[-1]: (r.status, r.http_status, r.waited, len(r.attempts or [])) for u, r in got.items()}
    assert status == {
        "1": ("ok", 200, 31.0, 3), "2": ("error", None, 3.0, 3), "3": ("broken", 500, 1.0, 2), "4": ("error", 429, 15.0, 3), "5": ("broken", 204, 0.0, 1), "6": ("error", 500, 3.0, 3),
        "7": ("broken", 410, 0.0, 1), "x": ("ok", None, 0.0, 0), None: ("broken", None, 0.0, 0),
    }
    assert [len(a) for a in asked[:3]] == [7, 5, 4] and asked[2] == {f"http://a.org/{k}" for k in (1, 2, 4, 6)}


def test_suffix_rules(spark):
    """Cases as the public list's own tests have them."""
    rules = spark.createDataFrame([(r,) for r in ("com", "jp", "ac.jp", "kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "us", "ak.us", "// jp2", " ")], "rule string")
    cases = {
        "com": None, "example.com": "example.com", "WwW.Example.COM": "example.com", "example.example": "example.example", "b.example.example": "example.example", "jp": None, "test.jp": "test.jp",
        "ac.jp": None, "test.ac.jp": "test.ac.jp", "kyoto.jp": None, "www.test.kyoto.jp": "test.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp",
        "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "ak.us": None, "www.test.ak.us": "test.ak.us",
        "10.0.0.1": None,
    }
    rows = spark.createDataFrame([(h, f"https://{h}/x") for h in cases] + [("none", None), ("bare", "nothing")], "host string, url string")
    got = {r.host: r.domain for r in hosts.with_registered_domain(rows, rules).collect()}
    assert got == cases | {"none": None, "bare": None}
    assert hosts.with_registered_domain(rows, rules.limit(0)).where("host = 'b.example.example'").first().domain == "example.example"


def plain_turns(items, groups, cap):
    """The loop itself: ``items`` are (title, url) in order, ``groups`` titles by group."""
    if len(items) <= cap:
        return [u for _, u in items]
    of = {}
    for g, titles in groups.items():
        for t in titles:
            of.setdefault(t, []).append(g)
    queues, loose, chosen = {}, [], []
    for title, url in items:
        for g in of.get(title, []):
            queues.setdefault(g, []).append(url)
        if title not in of:
            loose.append(url)
    while len(chosen) < cap and any(queues.values()):
        for g in sorted(queues):
            while queues[g] and len(chosen) < cap:
                url = queues[g].pop(0)
                if url not in chosen:
                    chosen.append(url)
                    break
    return chosen + [u for u in dict.fromkeys(loose) if u not in chosen][: cap - len(chosen)]


def test_turns_are_those_of_the_plain_loop(spark):
    rng, rows, named, want = random.Random(11), [], [], {}
    for scope in range(60):
        n, k = rng.randint(1, 30), rng.randint(1, 6)
        titles = [f"t{i}" for i in range(rng.randint(1, 20))]
        items = [(rng.choice(titles), f"u{i:02d}" if rng.random() < 0.8 else f"u{rng.randrange(n):02d}") for i in range(n)]
        urls = {}
        items = [(urls.setdefault(u, t), u) for t, u in items]  # a URL has one title
        groups = {f"g{g}": {t for t in titles if rng.random() < 0.4} for g in range(k)}
        rows += [(scope, t, u, i) for i, (t, u) in enumerate(items)]
        named += [(scope, g, t) for g, ts in groups.items() for t in ts]
        want[scope] = plain_turns(items, groups, 7)
    items = spark.createDataFrame(rows, "s int, title string, url string, rank int").repartition(3)
    groups = spark.createDataFrame(named, "s int, grp string, title string")
    got = {}
    for r in dedup.round_robin(items, groups, 7, by=["s"], at="place").orderBy("s", "place").collect():
        got.setdefault(r.s, []).append(r.url)
    assert got == want


def test_discovery_caps_known_acts_by_turns(spark):
    portals = spark.createDataFrame([("X", 1, "index", "https://a.gov.sg"), ("X", 2, "api", "https://b.gov.sg"), ("X", 3, "TBD", "https://c.gov.sg"), ("Y", 1, "seed_only", "https://d.gov.sg")], "economy string, portal int, strategy string, url string")
    offers = [("X", 1, i, f"Act {i}", f"https://a.gov.sg/{i}", 1 - i / 10) for i in range(6)] + [("X", 1, 6, "Banking Act", "https://a.gov.sg/6", 1.0), ("X", 3, 0, "Hidden", "https://c.gov.sg/0", 1.0)]
    candidates = spark.createDataFrame(offers, "economy string, portal int, pos int, title string, url string, score double")
    known = spark.createDataFrame([("X", "https://b.gov.sg/9"), ("X", "https://a.gov.sg/old"), ("Y", "https://z.org/1"), ("X", "https://a.gov.sg/6")], "economy string, url string")
    titles = spark.createDataFrame([("X", "ACT 1"), ("X", "act 3"), ("X", "Act 4 2011")], "economy string, title string")
    remap = spark.createDataFrame([("X", "https://a.gov.sg/old", "https://a.gov.sg/3")], "economy string, source string, target string")
    args = (portals, candidates, known, titles, remap)
    got = [(r.economy, r.url.rpartition("/")[2], r.tag) for r in discovery.discover(*args, excludes=["banking"], most_new=2).orderBy("economy", "pos").collect()]
    assert got == [("X", "1", "KNOWN"), ("X", "3", "KNOWN"), ("X", "4", "KNOWN"), ("X", "9", "KNOWN"), ("X", "6", "KNOWN"), ("X", "0", "NEW"), ("X", "2", "NEW"), ("Y", "1", "KNOWN")]
    groups = spark.createDataFrame([("X", "g1", "act 1"), ("X", "g2", "act 4"), ("X", "g1", "act 3")], "economy string, grp string, title string")
    got = [(r.economy, r.url.rpartition("/")[2]) for r in discovery.discover(*args, groups, most_known=2, most_new=0).orderBy("economy", "pos").collect()]
    assert got == [("X", "1"), ("X", "4"), ("Y", "1")]
    scored = discovery.title_scores(candidates.drop("score"), spark.createDataFrame([("banking",)], "term string"))
    assert {r.title: r.score for r in scored.where("portal = 1").collect()}["Banking Act"] == 1.0


def test_volumes_without_pages_or_headers(spark):
    spans = spark.createDataFrame([("a", 0, 0, 5.0, 100.0, 20.0, "Act 1"), ("a", 2, 1, 5.0, 100.0, 20.0, "Law 7 of"), ("a", 7, 2, 15.0, 100.0, 20.0, "CHAPTER 9"), ("a", 9, 3, 25.0, 100.0, 20.0, "Act 5")], "volume string, page int, no int, y double, height double, size double, text string")
    sizes = spark.createDataFrame([("a", 12), ("b", 120), ("c", 0)], "volume string, pages int")
    got = sorted(tuple(r) for r in volumes.acts_of_volumes(spans, sizes).collect())
    assert got == [("a", 0, "Act 1", 0, 1, False), ("a", 1, "Law 7 of", 2, 6, False), ("a", 2, "CHAPTER 9", 7, 11, False)] + [("b", i, f"Segment {i}", 50 * i, min(50 * i + 49, 119), True) for i in range(3)]
    extra = volumes.acts_of_volumes(spans.withColumn("text", F.lit("Loi no")), sizes, extra=["^loi"]).where("volume = 'a'")
    assert extra.count() == 3


def test_portals_of_one_domain_share_its_known_urls(spark):
    """Of many portals without an offer the first stands for all, and candidates are dealt by number."""
    from provenia.operators import discovery

    frame = spark.createDataFrame
    portals = frame([("E", n, "seed_only", f"https://www.p{n % 2}.gov.sg/") for n in range(1, 41)] + [("E", 50, "seed_only", "https://other.org/")], "economy string, portal long, strategy string, url string")
    none = frame([], "economy string, portal long, pos long, title string, url string, score double")
    known = frame([("E", f"https://p{n % 2}.gov.sg/act/{n}") for n in range(6)], "economy string, url string")
    found = discovery.discover(portals, none, known, frame([], "economy string, title string"), frame([], "economy string, source string, target string"))
    assert [r.url for r in found.orderBy("pos").collect()] == [f"https://p{n % 2}.gov.sg/act/{n}" for n in (1, 3, 5, 0, 2, 4)]
    assert "RepartitionByExpression" in found._jdf.queryExecution().toString()
