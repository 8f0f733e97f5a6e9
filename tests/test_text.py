"""Chunks, vectors, search, pages and conversations against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inquest.functions.strings import thread_title, title_case
from inquest.operators import conversations, pages, retrieval


def plain_chunks(text, size, overlap):
    out, held = [], ""
    for p in (p.strip() for p in text.split("\n\n")):
        if not p:
            continue
        if len(held) + len(p) + 2 <= size:
            held = held + "\n\n" + p if held else p
            continue
        out += [held] if held else []
        held = p if len(p) <= size else ""
        if len(p) > size:
            out += [c for c in (p[i:i + size].strip() for i in range(0, len(p), size - overlap)) if c]
    return out + ([held] if held else [])


def plain_vector(text):
    v = np.zeros(256)
    for t in text.lower().split():
        v[int(hashlib.md5(t.encode()).hexdigest(), 16) % 256] += 1
    return v / (math.sqrt(v @ v) or 1)


def test_chunking_equals_plain_code(spark):
    rng = np.random.default_rng(0)
    texts = ["", "  \n\n ", "one", "\n\n".join(f"paragraph {i} " + "x" * int(rng.integers(1, 90)) for i in range(40)),
             "y" * 2500, "a\n\n" + "word " * 400 + "\n\nend\u00a0", "\n\n\n\n".join(["é" * 299, "b", "c" * 301])]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    for size, overlap in ((300, 50), (900, 150)):
        got = {}
        for r in retrieval.chunk_documents(df, size=size, overlap=overlap).orderBy("document_id", "chunk_index").collect():
            got.setdefault(r["document_id"], []).append(r["content"])
        assert got == {i: c for i, t in enumerate(texts) if (c := plain_chunks(t, size, overlap))}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d1", "KPI sheet", "kpi_definition", "Revenue is net sales after returns", None, "me", None),
            ("d2", "Dictionary", "data_dictionary", "units: items sold. revenue: money received from sales", None, "me", None),
            ("d3", "Incident", "business_doc", "The North warehouse flooded in April and widget deliveries stopped", None, "me", "Ops"),
            ("d4", "Page", "web_page", "We sell widgets to the north and the south", "https://www.Example.com/a", "me", None),
            ("d5", "Report", "past_report", "Question: why did revenue decline", None, "you", None)]
    docs = spark.createDataFrame(rows, "document_id string, title string, document_type string, text string, "
                                       "url string, owner_id string, subject string").withColumn(
        "investigation_id", F.lit("i1"))
    return retrieval.index_documents(docs)


def test_search_equals_plain_cosine(chunks):
    rows = chunks.collect()
    for q in ("north widget deliveries", "revenue", "zzz"):
        scores = sorted(((round(float(plain_vector(q) @ plain_vector(r["content"])), 4), r["chunk_id"]) for r in rows),
                        key=lambda s: (-s[0], s[1]))
        got = [(r["score"], r["chunk_id"]) for r in retrieval.search(chunks, q, 3).collect()]
        assert got == [s for s in scores][:3]
        many = retrieval.search_many(chunks, {"a": q, "b": "sales"}, 3).where("query_id = 'a'").orderBy("rank")
        assert [(r["score"], r["chunk_id"]) for r in many.collect()] == got


def test_filters_apply_before_the_ranking(spark, chunks):
    assert {r["document_id"] for r in retrieval.search(chunks, "revenue", 9, owner="you").collect()} == {"d5"}
    assert {r["document_id"] for r in retrieval.search(chunks, "the", 9, scope="site:example.com").collect()} == {"d4"}
    assert {r["document_id"] for r in retrieval.search(chunks, "the", 9, scope="subject:ops").collect()} == {"d3"}
    bad = chunks.withColumn("vector", F.when(F.col("document_id") == "d1", F.slice("vector", 1, 8)).otherwise(F.col("vector")))
    assert "d1" not in {r["document_id"] for r in retrieval.search(bad, "revenue", 9).collect()}


def test_definitions_prefer_kpi_sheets(chunks):
    rows = {r["term"]: r for r in retrieval.definitions(chunks, ["revenue", "units", "weather"]).collect()}
    assert rows["revenue"]["source"] == "KPI sheet"
    assert "weather" not in rows
    terms = retrieval.plan_terms("Why did revenue, quickly decline in total?", ["region"])
    assert terms == ["revenue", "quickly", "decline", "total", "region"]


def test_passages_tell_mixed_sources(chunks):
    found = retrieval.passages(chunks, "north widget")
    first = found.orderBy("n").first()
    assert first["title"] == "Incident" and first["mixed_sources"]
    assert [r["heading"] for r in retrieval.brief_sections(found).collect()][0] == "Incident"


def test_stale_vectors_are_renewed_and_others_kept(chunks):
    old = chunks.withColumn("embedding", F.when(F.col("document_id") == "d1", "other").otherwise(F.col("embedding"))
                            ).withColumn("vector", F.when(F.col("document_id") == "d1", F.slice("vector", 1, 8))
                                         .otherwise(F.col("vector")))
    assert [(r["embedding"], r["chunks"]) for r in retrieval.stale_report(old).collect()] == [("other", 1)]
    new = retrieval.reembed(old)
    assert retrieval.stale_report(new).count() == 0
    a = {r["chunk_id"]: r["vector"] for r in chunks.collect()}
    assert {r["chunk_id"]: r["vector"] for r in new.collect()} == a


def test_related_history_leaves_out_the_own_report(chunks):
    assert retrieval.related_history(chunks, "why did revenue fall", "i2").count() == 1
    assert retrieval.related_history(chunks, "why did revenue fall", "i1").count() == 0


PAGE = "<html><head><title>{t} &amp; co</title><style>p{{}}</style></head><body><script>var a='<p>no</p>';</script>" \
       "<!-- <a href='/hidden'>x</a> --><p>{text}</p>{links}</body></html>"


def page(title, links, text="Some readable text about this page. " * 6):
    return PAGE.format(t=title, text=text, links="".join(f'<a class="k" href="{h}">go</a>' for h in links))


@pytest.fixture(scope="module")
def site(spark):
    rows = [("https://www.a.com/", page("home", ["/one", "two#x", "https://a.com/three/", "http://b.com/", "/login", "/x.png", "mailto:q@a.com"])),
            ("https://www.a.com/one", page("one", ["/deep", "/one"])), ("https://www.a.com/two", page("two", ["/deep"], "short")),
            ("https://a.com/three/", page("three", ["/four"])), ("https://www.a.com/deep", page("deep", ["/deeper"])),
            ("https://www.a.com/deeper", page("deeper", ["/last"])), ("https://www.a.com/last", page("last", [])),
            ("http://b.com", page("elsewhere", []))]
    return spark.createDataFrame(rows, "url string, html string")


def test_page_text_title_and_links(spark, site):
    first = site.where("url = 'https://www.a.com/'")
    d = pages.page_documents(first).first()
    assert d["title"] == "home & co" and "var a" not in d["text"] and d["text"].startswith("home & co\nSome readable")
    hrefs = [r["href"] for r in pages.page_hrefs(first).orderBy("position").collect()]
    assert hrefs == ["/one", "two#x", "https://a.com/three/", "http://b.com/", "/login", "/x.png", "mailto:q@a.com"]
    links = [r["dst_url"] for r in pages.page_links(first).orderBy("position").collect()]
    assert links[:4] == ["https://www.a.com/one", "https://www.a.com/two", "https://a.com/three", "http://b.com"]
    names = spark.createDataFrame([("https://a.com/my-first_page/?q=1",), ("https://a.com",)], "u string")
    assert [r[0] for r in names.select(pages.title_from_url(F.col("u"))).collect()] == ["my first page", "a.com"]


def test_links_are_resolved_like_addresses(spark):
    from urllib.parse import urldefrag, urljoin
    bases = ["https://a.com", "https://a.com/", "http://a.com/x/y?q=/z#f", "https://a.com/x/y/", "https://a.com?q=1"]
    hrefs = ["one", "/one/", "./one", "../one", "../../../one", "x/../y", "x/./y/..", "?k=v", "#top", "//b.com/z",
             "http://b.com/a", "mailto:q@a.com", "a?b=../c", ".", "..", "/", "a;b", "p?x=1&amp;y=2"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.select("b", "h", pages.resolved(F.col("b"), F.col("h")).alias("got")).collect():
        want = urldefrag(urljoin(r.b, r.h.replace("&amp;", "&")))[0]
        assert r.got == (want.rstrip("/") or want), r
    assert df.limit(1).select(pages.resolved(F.lit("no address"), F.col("h")).alias("g")).first().g is None


def test_walks_of_several_sites(spark, site):
    graph = pages.page_graph(site.unionByName(site))
    starts = spark.createDataFrame([("https://www.a.com",), ("http://b.com",), ("https://nowhere.com",)], "url string")
    got = {(r.start, r.visit, r.depth, r.url) for r in pages.walk_sites(graph, starts).collect()}
    assert got == {("https://www.a.com", 1, 0, "https://www.a.com"), ("https://www.a.com", 2, 1, "https://www.a.com/one"),
                   ("https://www.a.com", 3, 1, "https://a.com/three"), ("https://www.a.com", 4, 2, "https://www.a.com/deep"),
                   ("https://www.a.com", 5, 3, "https://www.a.com/deeper"), ("https://www.a.com", 6, 4, "https://www.a.com/last"),
                   ("http://b.com", 1, 0, "http://b.com")}
    assert pages.walk_sites(pages.page_graph(site.limit(0)), starts).count() == 0


def test_site_walk(site):
    got = [(r["depth"], r["url"]) for r in pages.reachable_pages(site, "https://www.a.com/#top").collect()]
    assert got == [(0, "https://www.a.com"), (1, "https://www.a.com/one"), (1, "https://a.com/three"),
                   (2, "https://www.a.com/deep"), (3, "https://www.a.com/deeper")]
    assert pages.reachable_pages(site, "https://www.a.com", max_pages=2).count() == 2
    assert pages.reachable_pages(site, "https://www.a.com", max_depth=0).count() == 1
    with pytest.raises(ValueError):
        pages.reachable_pages(site, "ftp://a.com")


def test_intents(spark):
    cases = {"hello there": "greeting", "bye": "farewell", "tell me a joke please": "off_topic", "ok thanks": "acknowledge",
             "what can you do": "capabilities", "what does 123% mean?": "explain", "break it down by region": "drill_down",
             "how many rows are there": "data_question", "why did it fall": "investigate", "write the report": "report",
             "which documents do you have": "list_documents", "what is a health score": "about_system", "hmm": "unclear"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["i"] for r in df.select("t", conversations.intent(
        F.col("t"), ["region"], has_report=True, has_documents=True).alias("i")).collect()}
    assert got == cases
    def one(text, **kw):
        return spark.createDataFrame([(text,)], "t string").select(conversations.intent(F.col("t"), **kw)).first()[0]
    assert one("why did it fall", has_dataset=False) == "need_data"
    assert one("why did it fall", has_dataset=False, has_documents=True) == "document_question"
    assert one("anything", awaiting=True) == "answer_request"


def test_titles(spark):
    df = spark.createDataFrame([("why did our revenue decline last quarter?",), ("o'neil AND mary-jane",)], "t string")
    assert df.select(thread_title(F.col("t"))).first()[0] == "Revenue decline last quarter"
    assert [r[0] for r in df.select(title_case(F.col("t"))).collect()] == [
        "why did our revenue decline last quarter?".title(), "o'neil AND mary-jane".title()]


def test_only_references_leave_for_python(spark):
    import html
    texts = ["a &amp; b", "&lt;x&gt", "&notit; &notin;", "&#65;&#x42&#0;", "&amp", "no reference", "", None, "&;&# &&amp;",
             "&" + "n" * 40, "\U0001f916&eacute\u0001&copy", "&#1;x", "&nbsp;" * 3, "a&b=c&lang=d"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("got", pages.decoded(F.col("t")))
    assert {r.i: r.got for r in df.collect()} == {
        i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "characters(regexp_extract_all(" in plan
