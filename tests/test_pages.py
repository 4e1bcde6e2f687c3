"""Markup, matching rules and crawl operators on cases worked out by hand."""

from pyspark.sql import functions as F

from loomnet.functions import dates as D
from loomnet.functions import markup as M
from loomnet.functions import text as X
from loomnet.operators import crawl as C
from loomnet.operators import links as L
from loomnet.operators import mentions as N
from loomnet.operators import orgs as O
from loomnet.operators import pairs as P
from loomnet.operators import prompts as Q


def test_element_tree():
    html = "<div id=menu><a href=x>Menu</a></div><div class='x entry-content'><p>One<br>two &amp; three<p>four " + "word " * 30 + "<script>no</script></div><ul><li><a>aaaaaaaaaaaa</a></ul>"
    assert M.main_text(html) == ("One two & three four " + "word " * 30).strip()
    assert M.main_text(None) == M.main_text("") == "" and M.main_text("<p>a<b>c</i></p></div>d") == "a c d"
    deep = "<div>" * 3000 + "x" * 60 + "</div>" * 3000
    assert M.parse(deep).text() == "x" * 60
    assert M.safe("class:Post-1") and not M.safe("id:nav")
    assert M._time_under("<div class='a content'><p><time datetime='2020-02-30'>x</time></p><p><time datetime='2020-2-3'>x</time></p></div>", 2, "content") == "2020-02-03"
    assert M.dated("<p>Posted by me 3. 4. 2020</p>") == "2020-04-03" and M.dated("<p>3. 4. 2020</p>") is None and M.dated("<time class=pubdate>2020-13-01</time>") is None


def test_personnel(spark):
    d = spark.createDataFrame([(1, "<div class=team><p>Jana Nová, director</p><p>Petr Malý</p><p>Jana Nová</p></div><p>Not Counted</p>"), (2, None)], "id int, html string")
    rows = d.lateralJoin(M.Personnel(F.col("html").outer())).select("id", "name", "role").collect()
    assert {tuple(r) for r in rows} == {(1, "Jana Nová", "director"), (1, "Petr Malý", None)}


def test_real_markup(spark):
    html = """<A class="b" HREF='/x y' title=z>Te<b>xt</b></A><a name=q>no</a><a data-href="/no">n</a><a\nhref=/u>U  v</a>"""
    d = spark.createDataFrame([(1, "https://www.h.org/d/p", html)], "page_id int, url string, html string")
    assert [(r.target, r.anchor, r.link_type) for r in L.links(d).orderBy("pos").collect()] == [("https://www.h.org/x y", "Te", "internal"), ("https://www.h.org/u", "U v", "internal")]
    m = d.withColumn("html", F.lit("""<HTML dir=ltr LANG=cs><meta content='d "q"' name=description><meta property="og:type" content=article>""")).transform(L.metadata).first()
    assert (m.lang, m.description, m.og_type, m.og_title, m.charset) == ("cs", 'd "q"', "article", None, "")


def test_paragraphs_and_dates(spark):
    d = spark.createDataFrame([("<p>a</p><p></p><p></p><p>b</p> <br/>c",)], "h string")
    assert d.select(X.html_to_text("h")).first()[0] == "a\n\nb\n\nc"
    one = lambda html, text: d.select(D.cascade(F.lit(html), F.lit(text)).alias("x")).first().x
    assert tuple(one("", "dne 5. ČERVENCE 2021 a 1. 1. 2020")) == ("2021-07-05", "text_cz") and tuple(one("", "1.1.2020 2019-02-03")) == ("2020-01-01", "text_num")
    assert tuple(one("<meta name='pubdate' x content='2018-01-02T'>", "")) == ("2018-01-02", "meta") and one("<meta name=published content=2018-01-02>", "none") is None
    graph = '<script type="application/ld+json">{"@graph": [{"@type": "x"}, {"dateCreated": "2017-05-06T1"}]}</script>'
    assert d.select(D.json_ld(F.lit(graph))).first()[0] == "2017-05-06"


def test_matching_rules(spark):
    docs = spark.createDataFrame([(1, "s", "Spolupracovat a position SIT Ústav ústav"), (2, "o", "nespoluprac sítě"), (3, "o", None)], "doc_id long, source string, text string")
    orgs = spark.createDataFrame([("a", "spoluprac", "ci"), ("b", "sit", "ci"), ("c", "Ústav", "cs"), ("c", "nic", "cs")], "org string, term string, mode string")
    assert {(r.doc_id, r.org, r.n_hits) for r in N.org_hits(docs, orgs).collect()} == {(1, "a", 1), (1, "b", 1), (1, "c", 1)}
    kw = spark.createDataFrame([("relation", "r", "sit", 1)], "category string, root string, term string, weight int")
    got = {r.doc_id: (list(r.targets), list(r.keywords)) for r in N.targets(docs, orgs.select("org", "term"), kw).collect()}
    assert got == {1: (["a", "b", "c"], ["sit"]), 2: ([], []), 3: ([], [])}


def test_overlapping_places(spark):
    d = spark.createDataFrame([(1, "aaa b aXa")], "doc_id long, text string")
    assert sorted((r.t, r.t_at) for r in P.places(d, ["aa", "B"], "t").collect()) == [("aa", 0), ("aa", 1), ("b", 4)]
    assert P.overlaps("abab") and not P.overlaps("abc")


def test_dictionary_and_names(spark):
    orgs = spark.createDataFrame([(1, "Arnika", "https://www.arnika.org/x"), (2, "Svaz pro les [x] - y", None)], "org_id long, name string, seed_url string")
    rows = {(r.org_id, r.text, r.kind, r.risk) for r in O.patterns(orgs, manual={"2": [("SPL", "cs")]}).collect()}
    assert rows == {(1, "arnika", "fullname", "HIGH"), (1, "arnik", "stem", "HIGH"), (2, "svaz pro les", "fullname", "review"), (2, "SPL", "manual", "review")}
    v = O.variations(spark.createDataFrame([(1, "Hnutí Duhaa z.s."), (2, "Arnika")], "ord int, name string"))
    assert {r.variation for r in v.collect()} == {"hnutí duhaa z.s.", "hnutí duhaa", "hnutí", "arnika"}


def test_prompts():
    parts = Q.sections("x\n## SYSTEM INTRO\nhello\n\n## CODEBOOK\nold\n## JSON_FORMAT\n{}\n## EXAMPLES\n\n")
    assert parts == {"SYSTEM_INTRO": "hello", "CODEBOOK": "old", "JSON_FORMAT": "{}", "EXAMPLES": ""}
    assert Q.system_prompt(parts, "new") == "hello\n\nnew\n\n{}"


def test_crawl_tables(spark):
    empty = C.stored(spark.createDataFrame([], "id long, org_id string, hash string, old_hash string, old_path string, refetch int"))
    assert empty.count() == 0
    base = spark.createDataFrame([(1, "x")], "id int, a string")
    assert [tuple(r) for r in C.updated(base, spark.createDataFrame([(1, "y", "z")], "id int, a string, b string"), "id", ["a"]).collect()] == [(1, "y")]
    with_ = C.without(spark.createDataFrame([(1,), (2,)], "session_id int"), spark.createDataFrame([(1, 9), (2, 8)], "session_id int, id int"), spark.createDataFrame([(1,)], "session_id int"))
    assert [x.count() for x in with_] == [1, 1]
