"""Behaviour on small rows: the cases that the queries' tables do not hold."""

import math
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.functions import urls as U
from provenia.operators import chunking, dedup, html, identity, lexical, providers, quality, retrieval, scoring, sinks
from provenia.sources import config, files
from provenia.streaming import runs

RULES = (tuple((k, k) for k in ("signup", "view", "click", "purchase")), ("signup", "view", "click", "purchase"), "view")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a a c"), (2, "d")], "seq int, text string")
    asked = spark.createDataFrame([("q", "b"), ("q", "b"), ("q", "zz")], "query string, term string")
    got = {r.seq: r.score for r in lexical.bm25(docs, asked).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert got[1] == 0 and got[2] == 0
    assert abs(got[0] - 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2))) < 1e-9


def test_bm25_negative_idf_is_floored(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(3)] + [(3, "b")], "seq int, text string")
    idf = {r.term: r.idf for r in lexical.inverse_frequencies(lexical.document_terms(docs, [], "text"), lexical.statistics(docs, [], "text"), []).collect()}
    a, b = math.log(1.5) - math.log(3.5), math.log(3.5) - math.log(1.5)
    assert abs(idf["b"] - b) < 1e-9 and abs(idf["a"] - 0.25 * (a + b) / 2) < 1e-9


def test_bm25_scores_equal_texts_once(spark):
    docs = spark.createDataFrame([("a", i, t) for i, t in enumerate(["red bolt", "red bolt", "old ring", "red bolt", "old bolt"])], "brand string, seq int, text string")
    asked = spark.createDataFrame([("q", "bolt"), ("q", "old")], "query string, term string")
    plain = {r.seq: r.score for r in lexical.bm25(docs, asked, ["brand"], zeros=False).collect()}
    once = lexical.bm25(docs, asked, ["brand"], "text", zeros=False, scored=docs.select("brand", "text").distinct())
    got = {r.text: r.score for r in once.collect()}
    assert len(got) == 3
    assert {r.seq: pytest.approx(got[r.text]) for r in docs.collect()} == plain


def test_titles_resolve_by_rule(spark):
    keys = spark.createDataFrame([(k,) for k in ("personal data protection act", "privacy act", "communications act (act 588)")], "key string")
    names = spark.createDataFrame([(n,) for n in ("Personal Data Protection Act 2012", "PDPA", "Act 588", "The Data Protection and Personal Act", "Data", None)], "name string")
    got = {r.name: (r.key, r.rule) for r in identity.match_titles(names, keys).collect()}
    assert got["Personal Data Protection Act 2012"] == ("personal data protection act", 0)
    assert got["PDPA"] == ("personal data protection act", 2)
    assert got["Act 588"] == ("communications act (act 588)", 1)
    assert got["The Data Protection and Personal Act"][1] == 3
    assert "Data" not in got and len(got) == 4


def test_prune_keeps_the_only_copy(spark):
    seed = spark.createDataFrame([("P7-I1", "a", "1"), ("P7-I2", "a", "2")], "indicator_id string, act string, section string")
    rows = spark.createDataFrame(
        [(1, "a", "1", "P7-I1", "KNOWN"), (2, "a", "1", "P7-I3", "KNOWN"), (3, "a", "2", "P7-I3", "KNOWN"), (4, "a", "1", "P7-I3", "NEW"), (5, "b", None, "P7-I3", "KNOWN")],
        "rec_no int, act string, section string, indicator_id string, tag string",
    )
    got = {r.rec_no: (r.outside, r.dropped) for r in dedup.prune_known(rows, seed).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, False), 4: (False, False), 5: (False, False)}


def test_keep_best_is_stable_and_idempotent(spark):
    rows = spark.createDataFrame([(1, "k", 0.5), (2, "K ", 0.9), (3, "k", 0.9), (4, "j", None)], "rec_no int, law string, confidence double")
    best = dedup.keep_best(rows, [dedup.key_form(F.col("law"))], [F.coalesce("confidence", F.lit(0.0))])
    assert {(r.rec_no, r.first_seen) for r in best.collect()} == {(2, 1), (4, 4)}
    again = dedup.keep_best(best.drop("first_seen"), [dedup.key_form(F.col("law"))], [F.coalesce("confidence", F.lit(0.0))])
    assert {r.rec_no for r in again.collect()} == {2, 4}


def test_fusion_prefers_what_both_lists_have(spark):
    one_, two = (spark.createDataFrame(x, "g string, seq int, rank int") for x in ([("q", 1, 1), ("q", 2, 2)], [("q", 2, 1), ("q", 3, 2)]))
    got = [r.seq for r in retrieval.fuse(one_, two, ["g"]).orderBy("rank").collect()]
    assert got == [2, 1, 3]


def test_chunks_are_sized_and_led(spark):
    body = "\n".join(f"({i}) " + "word " * 60 + "end." for i in range(1, 9))
    text = "PART I\nSection 1. Short.\nSection 2. Long thing.\n" + body
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string").withColumn("t", F.lit("My Act")), title="t").collect()
    assert {r.id for r in rows} == {1} and len(rows) >= 2
    assert all(len(r.text) <= chunking.MOST + 100 and r.text.startswith("My Act") for r in rows)
    assert [r.seq for r in rows] == list(range(len(rows)))


def test_hard_split_keeps_long_sentences():
    assert chunking.hard_split("a" * 3000, 100) == ["a" * 3000]
    assert all(len(x) <= 100 for x in chunking.hard_split("ab cd. " * 100, 100))


def test_pack_matches_the_plain_fold(spark):
    pieces = ["aa", "b" * 7, "c", "", "d" * 30, "e"]
    got = spark.createDataFrame([(pieces,)], "p array<string>").select(chunking.pack(F.col("p"), 10).alias("x")).first()[0]
    assert got == chunking.greedy(pieces, 10, "\n")
    assert spark.createDataFrame([([],)], "p array<string>").select(chunking.pack(F.col("p"), 10).alias("x")).first()[0] == []


def test_html_pages():
    page = html.Page("<html><body><nav>Menu</nav><h1 id='t'>Title</h1><p>Body text</p><a href='/x.css'>style</a><a href='a.pdf'>The document</a><div id='root'></div></body></html>")
    assert page.headings[0]["title"] == "Title" and page.headings[0]["anchor"] == "t" and "Body text" in page.headings[0]["text"]
    assert html.pdf_link(page, "https://e.org/d/") == "https://e.org/d/a.pdf"
    assert [x[0] for x in html.links(page, "https://e.org/d/")] == ["https://e.org/d/a.pdf"]
    assert html.render_mode(page, "x")[0] == "spa" and "Menu" not in page.text


def test_html_headings_hold_what_is_below_them():
    page = html.Page(
        """<body><nav><h2 id=menu>Menu</h2></nav><h1>Data <b>Act</b></h1><p>Preamble &amp; aim<h2 id=p1>Part 1</h2>in the open<div>first <i>part</i></div><script>x</script><h3>Section 1</h3><p>One.
        <h3>Section 2</h3><p>Two.</p><h2>Part 2</h2><p>a < b</p><section id=s><div><h4>Wrapped</h4></div><p>beside</p></section><a name=end></a><h1>Annex</h1><!-- note --><p>Last.</p><a></a><h1>No text</h1></body>"""
    )
    one, two, rest = "Section 1 One. Section 2 Two.", "Part 2 a < b Wrapped beside", "Preamble & aim"
    assert html.hierarchy(page, "https://e.org/act/") == [
        (0, 1, "DataAct", None, f"{rest} Part 1 in the open first part {one} {two}"), (1, 2, "Part 1", "https://e.org/act#p1", f"in the open first part {one}"),
        (2, 3, "Section 1", None, "One."), (3, 3, "Section 2", None, "Two."), (4, 2, "Part 2", None, "a < b Wrapped beside"), (5, 4, "Wrapped", "https://e.org/act#s", ""),
        (6, 1, "Annex", "https://e.org/act#end", "note Last."), (7, 1, "No text", None, ""),
    ]


def test_pages_are_sent_in_turns(spark):
    import pandas as pd

    class Pages:
        dtypes = [("page_id", "bigint")]

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return list(run(iter([pd.DataFrame({"page_id": range(300), "url": "https://a.org", "html": "<h1>Act</h1>"})])))

    sent = html.parse_pages(Pages(), lambda page, url, text: [(page.headings[0]["title"],)], "title string")
    assert sum(map(len, sent)) == 300 and max(map(len, sent)) <= 128


def test_scalar_functions(spark):
    assert one(spark, U.normalise_url(F.col("u")), u="HTTPS://E.org/A/?b=1&lang=en&a=&b=2#F/") == "https://e.org/a/?b=1&b=2#f"
    assert one(spark, U.registered_domain(F.col("u")), u="https://sso.agc.gov.sg/Act") == "agc.gov.sg"
    assert one(spark, T.normalise_title(F.col("t")), t=" Privacy  Act 1988 ") == "privacy act"
    assert one(spark, T.contains_verbatim(F.col("a"), F.col("b")), a="“Data  flows”", b='so "data\nflows" on') is True
    assert one(spark, T.contains_verbatim(F.col("a"), F.col("b")), a=" ", b="x") is False
    assert one(spark, T.nfkc(F.col("t")), t="ﬁn") == "fin"
    assert one(spark, T.title_case(F.col("t")), t="children's act") == "Children'S Act"
    assert one(spark, T.engine_id(F.col("t")), t="7") is None


def test_scores_and_gate(spark):
    counts = spark.createDataFrame([(4, 3, 9), (0, 0, 0)], "known_total int, known_matched int, new_discovered int")
    assert [(r.known_score, r.new_score, r.total_score) for r in scoring.with_points(counts).collect()] == [(30.0, 20.0, 50.0), (0.0, 0.0, 0.0)]
    rows = spark.createDataFrame([("P7", 0.7)], "pillar string, confidence double")
    assert not quality.gate(rows, "P7", 0.8) and quality.gate(rows, "P7", 0.8, "off") and quality.gate(rows, "P7", 0.7)


def test_cascade_falls_through(spark):
    class Down:
        name = "down"

        def available(self):
            return True

        def complete(self, prompt):
            raise providers.Unavailable("quota")

    got = providers.cascade(spark.createDataFrame([("p\nfirst",)], "prompt string"), "prompt", [Down(), providers.EchoProvider()]).first()
    assert got.provider == "echo" and got.attempts == ["down: quota", "echo: ok"]
    none = providers.cascade(spark.createDataFrame([("p",)], "prompt string"), "prompt", [Down()]).first()
    assert none.answer is None and none.attempts == ["down: quota"]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i % 3, i, ("signup", "view", "click", "purchase", "error")[i * 7 % 5]) for i in range(40)]
    lines = spark.createDataFrame(rows, "user_id long, event_id long, event_type string")
    lines.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    q = runs.fold_stream(stream, "user_id", "event_id", "event_type", RULES).writeStream.outputMode("update").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("runs").collect())) == sorted(map(tuple, runs.fold_batch(lines, "user_id", "event_id", "event_type", RULES).collect()))


def test_hard_split_is_the_same_in_both_forms(spark, data):
    texts = ["a. " * 900, "x" * 5000, "one.\n\n" + "two; " * 500 + "\n\n\nthree", "", " \n\n ", *[r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").where("text is not null").collect()]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", chunking.hard_pieces(F.col("t")).alias("h"), chunking.target_pieces(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.h == chunking.hard_split(texts[r.i]) and r.p == chunking.to_target(texts[r.i])


def test_articles_without_furniture():
    """A running header is no article boundary, and the title at the foot of a page no text."""
    body = "It is an offence to disclose personal data without consent of the individual. " * 2
    text = f"PART I\nSection 1. {body}\nSection 1\n14 My Act\nMy Act  15\nmore of it here\n2. {body}\n3A {body}"
    got = chunking.chunk(text, "My Act", [])
    assert [c[2] for c in got] == ["1", "2", "3A"] and "more of it here" in got[0][3] and "14 My Act" not in got[0][3]


def test_retrieval_of_documents(spark):
    chunks = spark.createDataFrame([(1, i, f"chunk {i} " + ("apple pie " * 3 if i in (2, 5) else "plain words "), str(i)) for i in range(8)] + [(2, 0, "nothing", "0")], "doc_id long, seq int, text string, section string")
    questions = spark.createDataFrame([("q", "apple pie", ["chunk 5"]), ("r", "pear", [])], "query string, question string, keywords array<string>")
    asked = spark.createDataFrame([("q",), ("unknown",)], "query string")
    seeds = spark.createDataFrame([("q", 1, "7"), ("q", 1, "2")], "query string, doc_id long, section string")
    got = retrieval.retrieve(chunks, questions, asked, seeds, providers.hashed_embedding).orderBy("doc_id", "rank").collect()
    one = [r for r in got if r.doc_id == 1]
    assert {r["query"] for r in got} == {"q"} and [r["seq"] for r in one[:2]] == [5, 2] and len({r["seq"] for r in one}) == len(one) == 8
    assert one[0]["context"].startswith("chunk 4") and "chunk 6" in one[0]["context"] and [r["rank"] for r in one] == list(range(1, 9))
    lacking = retrieval.inject(spark.createDataFrame([("q", 1, 0, 3.0, 1)], "query string, doc_id long, seq int, score double, rank int"), seeds, chunks, by=["doc_id"])
    assert [(r.seq, r.score, r.method) for r in lacking.orderBy("rank").collect()] == [(2, 4.0, "seed"), (7, 4.0, "seed"), (0, 3.0, "retrieved")]


def test_retrieval_splits_a_text_twice_at_most(spark):
    chunks = spark.createDataFrame([(1, i, f"the chunk {i} \u212a \u0130 of an act" if i % 3 else f"other {i} The act the", str(i)) for i in range(9)], "doc_id long, seq int, text string, section string")
    questions = spark.createDataFrame([("q", "the act the chunk", ["Act", "8"])], "query string, question string, keywords array<string>")
    seeds = spark.createDataFrame([], "query string, doc_id long, section string")
    plan = retrieval.retrieve(chunks, questions, questions, seeds, providers.hashed_embedding)._jdf.queryExecution().optimizedPlan().toString()
    splits = [part[:200] for part in plan.split("regexp_extract_all(")[1:] if "text#" in part[:200]]
    assert len(splits) == 2  # for its own counts, and for those of its document
    asked = questions.select("query", F.explode(lexical.tokens(F.col("question"))).alias("term"))
    terms = asked.agg(F.collect_set("term").alias("_asked"))
    held = spark.createDataFrame([(["act", "8"],)], "_keywords array<string>")
    own = {r["seq"]: r for r in lexical.weights(chunks, terms, ["doc_id"], ("seq",), held).collect()}
    for r in lexical.bm25(chunks, asked, ["doc_id"]).collect():
        got = own[r["seq"]]
        assert abs(sum(got["weights"].get(w, 0.0) for w in ("the", "act", "the", "chunk")) - r["score"]) < 1e-12
        assert sorted(got["held"]) == (["8", "act"] if r["seq"] == 8 else ["act"])
    assert spark.sql("select 'a\u212aB \u0130c' as t").select(lexical.tokens(F.col("t"))).first()[0] == ["a", "b", "c"]


def test_compatibility_form_is_made_of_arrow_arrays():
    texts = ["\ufb01ne", None, "e\u0301 \u2460", ""] * 50
    got = T.nfkc.func(pa.array(texts))
    assert isinstance(got, pa.Array) and got.to_pylist() == ["fine", None, "\u00e9 1", ""] * 50
    assert T.nfkc.func(pa.array([], pa.string())).to_pylist() == []


def test_round_robin_takes_shared_items_once(spark):
    items = spark.createDataFrame([(t, u, i) for i, (t, u) in enumerate([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("x", "9"), ("e", "5")])], "title string, url string, rank int")
    groups = spark.createDataFrame([("g1", "a"), ("g2", "a"), ("g2", "b"), ("g1", "c"), ("g1", "d")], "grp string, title string")
    assert [r.url for r in dedup.round_robin(items, groups, 3).collect()] == ["1", "2", "3"]
    assert [r.url for r in dedup.round_robin(items, groups, 5).collect()] == ["1", "2", "3", "4", "9"]
    assert dedup.round_robin(items, groups, 6).count() == 6


def test_round_robin_shortens_queues_before_they_meet(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(dedup, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.localCheckpoint())
    items = spark.range(200).selectExpr("concat('t', id) as title", "concat('u', id) as url", "id as rank")
    groups = items.selectExpr("if(rank % 2 = 0, 'a', 'b') as grp", "title")
    got = dedup.round_robin(items, groups, 6).collect()
    assert [r.title for r in got] == ["t0", "t1", "t2", "t3", "t4", "t5"]
    assert "WindowGroupLimit" in plans[0]


def test_providers(tmp_path):
    class One:
        name, model = "one", "m1"

        def __init__(self, answer, up=True):
            self.answer, self.up, self.calls = answer, up, 0

        def available(self):
            return self.up

        def complete(self, prompt):
            self.calls += 1
            if isinstance(self.answer, Exception):
                raise self.answer
            return self.answer

    good, down, dead = One('{"ok": true}'), One("", False), One(providers.Unavailable("quota"))
    assert providers.pinned([down, good]) is good and providers.version(good, "ocr") == "one/m1 + ocr" and providers.version(None) == "unknown/unknown"
    with pytest.raises(providers.NoProvider):
        providers.pinned([down])
    assert providers.smoke_check(good) == (True, "one") and not providers.smoke_check(One("prose"))[0] and not providers.smoke_check(dead)[0]
    latched = providers.Latched(dead)
    with pytest.raises(providers.Unavailable):
        latched.complete("x")
    assert not latched.available() and providers.Latched(good).available() and not providers.Latched(good, 0).available()


def test_configuration(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/sg.json").write_text('{"economy_name": "Singapore", "iso_code": "sg", "languages": ["en"], "portals": [{"name": "p", "url": "u"}]}')
    (tmp_path / "e/au.json").write_text('{"economy_name": "Australia", "iso_code": "AU", "languages": []}')
    rows = config.economies(spark, str(tmp_path / "e"))
    assert config.economy(rows, " singapore ").first().iso_code == "SG" and config.economy(rows, "au").first().economy_name == "Australia"
    with pytest.raises(config.UnknownEconomy, match="Singapore"):
        config.economy(rows, "Singapor")
    assert {r.economy_name: list(r.w) for r in rows.select("economy_name", config.economy_violations().alias("w")).collect()} == {"Singapore": [], "Australia": ["languages must not be empty", "at least one portal is required"]}
    (tmp_path / "t.json").write_text('[{"indicator_id": "P6-I1", "probe_keywords": ["a"]}, {"indicator_id": "P6-I2"}]')
    assert [(r.name, r.probe_keywords) for r in config.taxonomy(spark, str(tmp_path / "t.json")).orderBy("indicator_id").collect()] == [("", ["a"]), ("", [])]
    assert config.first_file(spark, [str(tmp_path / "none"), str(tmp_path / "t.json")]) == str(tmp_path / "t.json")
    assert config.key_of({"LLM_API_KEY": "b", "X": " "}, "X") == "b" and config.key_of({"X": "a", "LLM_API_KEY": "b"}, "X") == "a" and config.key_of({}, "X") == ""


def test_word_processor_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f"<w:p><w:pPr><w:pStyle w:val='{s}'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("My Act", "Title") + p("Part", "h2") + p("Some text") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "data_act.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles xmlns:w='{w}'><w:style w:styleId='h2'><w:name w:val='heading 2'/></w:style></w:styles>")
    (tmp_path / "broken.docx").write_bytes(b"nothing")
    got = {r.path.rpartition("/")[2]: r for r in files.docx_files(spark, str(tmp_path)).collect()}
    assert got["data_act.docx"].text == "My Act\nPart\nSome text\na | b" and [tuple(h) for h in got["data_act.docx"].headings] == [(0, "My Act"), (2, "Part")]
    assert got["broken.docx"].text is None and "BadZipFile" in got["broken.docx"].error
    assert {r.act_title for r in files.given_files(spark, str(tmp_path), "SG").collect()} == {"Data Act", "Broken"}


def test_written_tables(spark, data, tmp_path):
    from provenia import engine
    from provenia.plans import documents as queries

    records = queries._records(spark, data).limit(200).withColumn("verbatim_snippet", F.lit('a "quoted", line\nand more'))
    counts = engine.write(records, queries._INDICATORS, str(tmp_path))
    assert counts["written"] > 0 and counts["written"] + counts["skipped"] == 200
    again = sinks.read_csv(spark, f"{tmp_path}/records_csv")
    assert again.columns == list(quality.COLUMNS) and again.count() == counts["written"] and {r[0] for r in again.select("verbatim_snippet").collect()} == {'a "quoted", line\nand more'}
    docs = spark.createDataFrame([("u1", bytearray(b"x")), ("u2", bytearray(b"x")), ("u3", None)], "source_url string, content binary")
    kept = {r.source_url: r.archive_url for r in sinks.snapshots(docs, f"{tmp_path}/snap").collect()}
    assert kept["u1"] == kept["u2"] and kept["u3"] is None and spark.read.parquet(f"{tmp_path}/snap").count() == 1


def test_progress_lines():
    state = (-1, 0, 0, 0)
    for line in ("→ Loading economy config", "✓ Seed data — 3", "→ Fetching — a", "RAG retrieval", "noise", "→ Fetching — b", "Outputs written — 3 records"):
        state = runs.advance(state, line)
    assert state == (runs.STAGES.index("write"), 7, 6, 1)


class Sent:
    """A frame whose mapped batches are seen as they are sent."""

    def __init__(self, *dtypes):
        self.dtypes = list(dtypes)

    def mapInPandas(self, run, _):  # noqa: N802
        self.run = run
        return self

    mapInArrow = mapInPandas  # noqa: N815

    def select(self, *_):
        return self

    where = crossJoin = withColumnsRenamed = select  # noqa: N815


def test_chunks_and_headings_are_sent_in_turns(spark):
    import pandas as pd

    from provenia.operators import chunking

    frame = pd.DataFrame({"id": range(300), "text": "1. Heading\n" + "words of it " * 20, "title": "Act", "headings": "[]"})
    docs = Sent(("id", "bigint"), ("text", "string"))
    for made, columns in ((lambda: chunking.chunk_documents(docs, "id"), list(frame)), (lambda: chunking.heading_table(docs, "id"), ["id", "text"])):
        sent = list(made().run(iter([frame[columns]])))
        assert sum(map(len, sent)) == 300 and max(map(len, sent)) <= 64


def test_blocks_of_search_are_scored_in_turns(spark):
    import numpy as np
    import pyarrow as pa

    from provenia.operators import retrieval

    rng = np.random.default_rng(1)
    vectors, asked = rng.normal(size=(500, 8)), rng.normal(size=(300, 8))
    sides = [([len(x)], [np.arange(len(x)).tobytes()], [x.tobytes()]) for x in (vectors, asked)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for side in sides for c in side], names=["n", "keys", "matrix", "_n", "_keys", "_matrix"])
    for most, each in ((None, 500), (7, 7)):
        sent = list(retrieval.dense_blocks(Sent(), Sent(), most=most).run(iter([batch])))
        assert sum(b.num_rows for b in sent) == 300 * each and max(b.num_rows for b in sent) <= 128 * each
        last = sent[-1].to_pandas().query("query == 299")
        want = vectors @ asked[299]
        assert np.allclose(last["score"], want[last["seq"]]) and last["score"].max() == max(want.round(9) if most else last["score"])


def test_sorted_rows_are_dealt_by_number(spark, data):
    from provenia import plans

    made = plans.queries()["win_merge_short"](spark, data)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_large_files_are_told_by_their_first_split(spark, tmp_path, monkeypatch):
    import gzip

    from provenia.sources import readers

    page = b"\n\r\n<!-- long -->\n<HTML>\n" + b"<p>text\n" * 400
    for name, content in {"a.bin": b"%PDF-1.7\n" + bytes(range(256)) * 20, "b": page, "c": b"\n" * 600 + page, "d.gz": gzip.compress(bytes(range(256)) * 9 + page), "e": b"\xff\xd8\xff\n" * 900, "f": b"x", "g": b"PAR1" + bytes(4000)}.items():
        (tmp_path / name).write_bytes(content)
    told = lambda: {r.path[-1]: (r.length, r.kind) for r in readers.binary_files(spark, str(tmp_path)).collect()}
    want = told()
    assert [want[k][1] for k in "nbcefg"] == ["PDF", "HTML", "UNKNOWN", "IMAGE", "UNKNOWN", "PARQUET"] and len(want) == 7
    monkeypatch.setattr(readers, "WHOLE", 64)
    assert told() == want
    assert "Format: Text" in readers.binary_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
