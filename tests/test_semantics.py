"""Cases worked out by hand: traps of order, ties and odd values."""

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import elements as E
from weftline.operators import exports as X
from weftline.operators import models as M
from weftline.operators import pages as P
from weftline.operators import sequences as Q
from weftline.operators import stores as S
from weftline.sources import html as H
from weftline.streaming import steps as ST

PAGE = """<html><head><title> A &amp; B </title><meta name="description" content=" about  it "></head><body><nav><a href="/x">Home page</a></nav>
<article><h1>Top</h1><p>Mail bob@x.org or call +1 (555) 123-4567</p><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><aside>kept</aside></article>
<form><input type="search" name="q" placeholder="Search"><button>Go</button></form><script>var t="</p>";</script></body></html>"""


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("raw", "want"), [("a  \tb", "a b"), ("﻿x ", "x"), ("", ""), ("\x0b1 2", "1 2")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize(F.col("v")), v=raw) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8))
def test_normalize_twice_changes_nothing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    once = df.select(T.normalize(F.col("v")).alias("v"))
    assert [r.v for r in once.collect()] == [r.v for r in once.select(T.normalize(F.col("v")).alias("v")).collect()]


@pytest.mark.parametrize(("raw", "want"), [("https://WWW.A.com/x", "a.com"), ("a.com/x", "a.com"), ("sub.a.com", "sub.a.com"), (" ", "")])
def test_normalize_host(spark, raw, want):
    assert one(spark, U.normalize_host(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("12abc", 6), (" 7", 6), ("-3", 1), ("", 4), ("3.9", 3), ("1e3", 1)])
def test_clamp(spark, raw, want):
    assert one(spark, T.clamp_int(F.col("v"), 1, 6, 4), v=raw) == want


def test_search_hosts_are_parts(spark):
    assert one(spark, P.is_search_host(F.col("v")), v="notbing.com")


def test_one_source_a_host_even_if_fewer(spark):
    rows = [(1, "http://b.com/1", "b.com", "longer", 0), (1, "http://b.com/2", "b.com", "t", 1), (1, "http://a.com", "a.com", "x", 2), (1, "u1", "", "y", 3), (1, "u2", "", "z", 4)]
    df = spark.createDataFrame(rows, "task_id int, url string, host string, title string, pos int")
    got = [r.url for r in P.diversified(df, ["task_id"], ["b.com"], 6).orderBy("rank").collect()]
    assert got == ["http://b.com/2", "u1", "u2", "http://a.com"]


def test_counters(spark):
    kinds = ["a", "a", "a", "b", "b", "a"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "s int, i int, k string")
    assert [r.repeats for r in Q.repeats(df, F.col("k"), ["s"], ["i"]).orderBy("i").collect()] == [0, 1, 2, 0, 1, 0]
    moved = [("scroll", 23), ("wait", 0), ("scroll", 5), ("scroll", 24), ("scroll", 0), ("click", 0)]
    df = spark.createDataFrame([(1, i, k, m) for i, (k, m) in enumerate(moved)], "s int, i int, k string, m int")
    scroll = F.col("k") == "scroll"
    got = Q.since_reset(df, scroll & (F.col("m") < 24), (scroll & (F.col("m") >= 24)) | (F.col("k") == "click"), ["s"], ["i"])
    assert [r.n for r in got.orderBy("i").collect()] == [1, 1, 2, 0, 1, 0]


def test_seeing_again_keeps_the_first_place(spark):
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(["a", "b", "a", "c", "d"])], "s int, i int, h string")
    assert [r.value for r in Q.first_seen_last_n(df, F.col("h"), 3, ["s"], ["i"]).orderBy("pos").collect()] == ["b", "c", "d"]


def test_unknown_model_is_free_and_upsert_keeps_places(spark):
    usage = spark.createDataFrame([("gpt-4o", 1_000_000, 0), ("none", 5, 5)], "model string, prompt_tokens bigint, completion_tokens bigint")
    assert {r.model: r.cost for r in S.usage_by_model(usage, S.pricing(spark)).collect()} == {"gpt-4o": 2.5, "none": 0.0}


def test_new_elements_need_the_same_url(spark):
    cur = spark.createDataFrame([(1, "u", 1, "a"), (1, "u", 2, "b"), (2, "v", 1, "a"), (3, "w", 1, "a")], "page_id int, url string, pos int, text string")
    before = spark.createDataFrame([(1, "u", 1, "a"), (2, "other", 1, "x")], "page_id int, url string, pos int, text string")
    got = {(r.page_id, r.pos): r.is_new for r in E.enrich(cur, before).collect()}
    assert got == {(1, 1): False, (1, 2): True, (2, 1): False, (3, 1): False}


def test_csv_keeps_bytes(spark):
    df = spark.createDataFrame([(1, 'a"b', "x\ny"), (2, None, ",")], "i int, v string, w string")
    assert X.csv_text(df, ["v", "w"], "i").first().content == '"v","w"\r\n"a""b","x\ny"\r\n"",","'


def test_parser():
    page = H.readable("http://h/", PAGE)
    assert page["title"] == "A & B" and page["headings"] == ["Top"] and page["description"] == "about it"
    assert page["tables"] == [[["k", "v"], ["a", "1"]]] and page["emails"] == ["bob@x.org"] and page["phones"] == ["+1 (555) 123-4567"]
    assert "<aside>kept</aside>" in page["cleaned_html"] and "nav" not in page["cleaned_html"] and "script" not in page["cleaned_html"]
    roles = [(e["role"], e["editable"]) for e in H.elements(PAGE)]
    assert roles == [("link", False), ("searchbox", True), ("button", False)]
    assert H.elements(None) == [] and H.readable(None, None)["text"] == ""


def test_model_calls(spark):
    df = spark.createDataFrame([(1, "ok", "body one"), (2, "bad", "body two")], "i int, prompt string, text string")

    def model(p):
        if p == "bad":
            raise RuntimeError("no answer")
        return '<blocks>{"summary": "S", "rows": [{"a": 1}]}</blocks>'

    got = {r.i: r for r in M.digested(M.answered(df, "prompt", model, 2), "text").collect()}
    assert (got[1].summary, got[1].failed) == ("S", False) and (got[2].summary, got[2].confidence, got[2].failed) == ("body two", "medium", True)


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), i % 3, ["view", "error", "error", "click"][i // 3 % 4]) for i in range(60)]
    for n in range(3):
        pdf = pd.DataFrame(rows[n * 20 : n * 20 + 20], columns=["event_id", "ts", "user_id", "event_type"])
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = ST.session_state(ST.read_steps(spark, str(tmp_path / "in"), batch.schema))
    out = {r.user_id: (r.steps, r.longest, r.repeats, r.failures) for r in ST.latest(ST.drain(stream, "state_test", "update")[1], ["user_id"], "steps").collect()}
    bad = F.col("event_type") == "error"
    own = Q.repeats(Q.since_reset(batch, bad, ~bad, ["user_id"], ["ts", "event_id"], "failures"), F.col("event_type"), ["user_id"], ["ts", "event_id"])
    want = {r.user_id: (r.n, r.m, r.a, r.b) for r in own.groupBy("user_id").agg(F.count("*").alias("n"), F.max("repeats").alias("m"), F.max_by("repeats", "ts").alias("a"), F.max_by("failures", "ts").alias("b")).collect()}
    assert out == want


def test_long_pages_are_read_whole():
    words = [f"word{i}" for i in range(9000)]
    table = "<table>" + "".join("<tr>" + "".join(f"<td>{r}.{c}</td>" for c in range(12)) + "</tr>" for r in range(15)) + "</table>"
    parts = [f"<h2>Head {i}</h2><a href='/{i}'>Link {i}</a> m{i}@x.org, +1 555 {1000 + i} {2000 + i}; {' '.join(words[i * 100 : i * 100 + 100])}" for i in range(90)]
    page = H.readable("u", "<body>" + "".join(parts) + table * 6 + "<table></table><p>the end</body>")
    assert len(page["text"]) > 80_000 and page["text"].endswith("the end") and all(w in page["text"] for w in ("word0 ", "word4500 ", "word8999"))
    assert page["cleaned_html"].endswith("<p>the end</p>") and page["cleaned_html"].count("word") == 9000
    assert page["headings"] == [f"Head {i}" for i in range(90)] and page["links"] == [{"text": f"Link {i}", "href": f"/{i}"} for i in range(90)]
    assert page["tables"] == [[[f"{r}.{c}" for c in range(12)] for r in range(15)]] * 6
    assert page["emails"] == [f"m{i}@x.org" for i in range(90)] and page["phones"] == [f"+1 555 {1000 + i} {2000 + i}" for i in range(90)]
    nested = H.readable("u", "<table><tr><td>a<table><tr><td>b<td>c</table></table>")
    assert nested["tables"] == [[["a b c", "b", "c"], ["b", "c"]], [["b", "c"]]]


def test_all_elements_of_a_page():
    same, long = "The same beginning " * 10, "x" * 100
    many = "".join(f"<li><a href='/{i}'>Link {i}</a><button>{same}{i}</button>" for i in range(3000))
    named = f"<div id='{'d' * 200}'><p><input name='{long}1' title='{long}2' id='{long}3' placeholder='{long}4' aria-label='{long}5'></p><b><button>{same}</button><button>{same}</button></b></div>"
    got = H.elements(f"<body><ul>{many}</ul>{named}{''.join(f'<i><a href=q>{same}{i}</a></i>' for i in range(3))}</body>")
    links, buttons = ([e for e in got if e["tag"] == tag] for tag in ("a", "button"))
    assert [e["href"] for e in links] == [f"/{i}" for i in range(3000)] + ["q"] * 3 and [e["text"] for e in links[3000:]] == [f"{same}{i}" for i in range(3)]
    assert [e["text"] for e in buttons] == [f"{same}{i}" for i in range(3000)] + [same.strip()] * 2
    assert [e["dom_path"] for e in buttons[2999:]] == ["body>ul>li:nth-of-type(3000)>button", f"div#{'d' * 200}>b>button:nth-of-type(1)", f"div#{'d' * 200}>b>button:nth-of-type(2)"]
    field = next(e for e in got if e["tag"] == "input")
    assert [field[k] for k in ("name", "title_attr", "id", "placeholder", "aria_label", "dom_path")] == [f"{long}{i}" for i in range(1, 6)] + [f"input#{long}3"]
    assert [e["uid"] for e in got] == [f"nx-{i}" for i in range(1, len(got) + 1)] and len(got) == 6006


def test_deep_and_unclosed_markup():
    from weftline.sources import html as H

    for piece in ("<b>x", "<li>x", "<p>x", "<div>x", "<td>x"):
        page = H.readable("u", piece * 5000)
        assert page["text"].count("x") == 5000 and page["cleaned_html"]
        assert H.elements(piece * 3000 + "<a href=q>go</a>")[0]["href"] == "q"
    page = H.readable("u", "<body><ul><li>one<li>two <ul><li>in</ul><li>three</ul><table><tr><td>a<td>b<tr><th>c</table><p>first<p>second<div>third</div></body>")
    assert page["cleaned_html"] == "<ul><li>one</li><li>two <ul><li>in</li></ul></li><li>three</li></ul><table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table><p>first</p><p>second</p><div>third</div>"
    assert page["tables"] == [[["a", "b"], ["c"]]]


def test_result_cards():
    from weftline.sources import html as H

    page = """<div class="x g"><a href="/one"><h3>First  title</h3></a><div class="snippet">About one</div></div><article><a href="https://b.org/two">Two</a><p>About <b>two</b></p></article>
    <div class="g"><a href="/one">again</a></div><div class="result"><h2>No link</h2></div><li class="b_algo"><a href="javascript:x()">odd</a></li><div class="b_caption"><p>x</p></div><a href="/menu">A menu entry</a>"""
    assert H.result_cards("https://s.org/q", page) == [
        {"href": "https://s.org/one", "host": "s.org", "title": "First title", "snippet": "About one"},
        {"href": "https://b.org/two", "host": "b.org", "title": "Two", "snippet": "About two"},
    ]
    plain = '<li>Around <a href="up">A longer text</a></li><a href="/b">short</a><a href="/c" aria-label="Label of it"></a>'
    assert H.result_cards("https://s.org/a/q", plain) == [
        {"href": "https://s.org/a/up", "host": "s.org", "title": "A longer text", "snippet": "Around A longer text"},
        {"href": "https://s.org/c", "host": "s.org", "title": "Label of it", "snippet": ""},
    ]
    assert H.result_cards(None, None) == [] and H.result_cards("x", '<a href="http://[x">A broken address</a>') == []


def test_cards_without_titles_search_hosts_and_order():
    from weftline.sources import html as H

    def card(href, inner=""):
        return f'<div class=g><a href="{href}"></a>{inner}</div>'

    page = card("https://www.x.org/1") + card("https://google.com/a", "<h3>Long search title</h3>") + card("https://y.org", "<h3>Tiny</h3>") + card("https://z.org", "<h3>A much longer one</h3>") + '<div style="display:none">' + card("https://h.org", "<h3>Hidden</h3>") + "</div>"
    assert [(c["host"], c["title"]) for c in H.result_cards(None, page, ["y.org"])] == [("y.org", "Tiny"), ("z.org", "A much longer one"), ("x.org", "x.org")]
    assert len(H.result_cards(None, page, most=1)) == 1
    # only a search engine's card: the fallback takes links
    only = card("https://google.com/a", "<h3>Search</h3>") + '<a href="https://q.org">A long enough link</a>'
    assert [c["host"] for c in H.result_cards(None, only)] == ["q.org"]


def test_nested_cards_take_linear_time():
    import time

    from weftline.sources import html as H

    page = "<article><p>x<a href=/q>some longer text</a>"
    start = time.perf_counter()
    assert len(H.result_cards("https://s.org/", page * 3000)) == 1
    assert time.perf_counter() - start < 10


def test_scraped_datasets_hold_table_rows(spark):
    from weftline.plans import pipelines as PL

    pages = spark.createDataFrame([(1, "https://a.org/x", "<body><h1>Head</h1><a href=/l>Link</a><table><tr><td>a<td>b</table></body>"), (2, None, None)], "page_id bigint, url string, html string")
    got = [(r.section, r.value, r.text, r.cells) for r in PL.scrape(pages).orderBy("section").collect()]
    assert got == [(0, "Head", None, None), (1, None, "Link", None), (2, None, None, {"Column 1": "a", "Column 2": "b"})]


def test_a_page_captured_twice_is_two_sources(spark):
    from weftline.plans import pipelines as PL

    html = "<title>t</title><body><h1>A title</h1>words of {}</body>"
    pages = spark.createDataFrame([(1, "https://a.org/x", html.format("one")), (51, "https://a.org/x", html.format("two")), (2, "https://b.org/y", html.format("three"))], "page_id bigint, url string, html string")
    assert sorted(r.url for r in PL.research(pages, []).collect()) == ["https://a.org/x", "https://b.org/y"]


def test_compacted_page(spark):
    from weftline.operators import agents as A

    schema = """id int, mode string, text string, readable_text string, headings array<string>, tables array<array<array<string>>>, links array<struct<text:string,href:string,selector:string>>,
        elements array<struct<uid:string,label:string,ax_name:string,text:string,href:string>>, anchors array<struct<badge:int,label:string,center:struct<x:int,y:int>>>, other string"""
    long = "x" * 9000
    full = (long, None, ["h"] * 30, [[["c"]]] * 5, [("l" * 99, None, "s")] * 12, [("u", None, "", "t" * 200, "e" * 300)] * 40, [(1, long, (2, 3))] * 20, "kept")
    none = (None, None, None, None, None, None, None, None)
    df = spark.createDataFrame([(0, "minimal", *full), (1, "compact", *full), (2, "normal", *full), (3, None, *full), (4, "minimal", *none), (5, "normal", *none)], schema)
    got = {r["id"]: r for r in A.compacted_page(df).collect()}
    a, b = got[0], got[1]
    assert (len(a["text"]), len(b["text"]), len(a["readable_text"]), len(b["readable_text"])) == (700, 1800, 2200, 5200)
    assert [len(r[c]) for r in (a, b) for c in ("headings", "tables", "links", "elements", "anchors")] == [8, 1, 4, 18, 10, 16, 2, 10, 32, 18]
    assert a["links"][0] == ("l" * 60, "", "s")
    assert a["elements"][0] == ("u", "t" * 48, "t" * 48, "t" * 42, "") and b["elements"][0] == ("u", "t" * 100, "t" * 100, "t" * 80, "e" * 120)
    assert a["anchors"][0]["center"] is None and b["anchors"][0]["center"] == (2, 3) and len(b["anchors"][0]["label"]) == 90
    assert all(r["other"] == "kept" for r in (a, b))
    assert tuple(got[2])[2:] == tuple(got[3])[2:] == tuple(df.where("id = 2").first())[2:]
    assert got[4]["text"] == "" and got[4]["links"] == [] and got[4]["anchors"] == [] and got[5]["links"] is None


@pytest.mark.parametrize("made", [H.readable_pages, H.search_cards, H.page_elements, lambda df: M.answered(df, "html", str.upper)])
def test_a_batch_is_worked_on_in_pieces(spark, monkeypatch, made):
    page = "<body><a href='http://h.org/a'>A link of a page</a><p>" + "word " * 200
    df = spark.createDataFrame([(0, "http://h/", None)], "page_id bigint, url string, html string")
    batch = pa.RecordBatch.from_pydict({"page_id": range(3000), "url": ["http://h/"] * 3000, "html": [page] * 2999 + [None]})
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    out = list(made(df)(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and max(b.nbytes for b in out) <= 1 << 20
    ids = [i for b in out for i in b.column("page_id").to_pylist()]
    assert ids[:2999] == list(range(2999)) and len(ids) in (2999, 3000)
