import json
import os
import time
import zipfile

from pyspark.sql import functions as F

from loomnet.sources import readers as R
from loomnet.sources import writers as W
from loomnet.streaming import frontier as S


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_text_tree_and_diff(spark, tmp_path):
    r = str(tmp_path)
    put(f"{r}/a/2020/Org A/text/1.txt", "one\ntwo")
    put(f"{r}/a/2021/B/text/2.txt", "x")
    put(f"{r}/a/other/B/text/3.txt", "y")
    d = R.text_tree(spark, f"{r}/a")
    assert {(x.year, x.org, x.filename, x.text) for x in d.collect()} == {("2020", "Org A", "1.txt", "one\ntwo"), ("2021", "B", "2.txt", "x")}
    assert R.text_tree(spark, f"{r}/a", other=True).count() == 3 and R.text_tree(spark, f"{r}/a", ["2021"]).count() == 1
    e = d.withColumn("text", F.upper("text")).filter("year = 2021").unionByName(d.limit(0))
    assert {x.state for x in W.tree_diff(d, e).collect()} == {"missing", "differs"}
    W.documents(d, f"{r}/out")
    assert spark.read.parquet(f"{r}/out").filter("year = 2020").count() == 1


def test_json_lines(spark, tmp_path):
    p = f"{tmp_path}/2020_pairs.jsonl"
    put(p, '{"id": "a", "llm_label": "x"}\nbroken\n\n{"id": "b"}\n')
    ddl = "id string, llm_label string"
    assert {r.id for r in R.json_lines(spark, p, ddl).filter("id is not null").collect()} == {"a", "b"}
    assert [r._corrupt_record for r in R.json_lines(spark, p, ddl, "keep").cache().filter("_corrupt_record is not null").collect()] == ["broken"]
    assert R.yearly_json(spark, str(tmp_path), [2019, 2020], ddl, True).count() == 1


def test_dictionaries_and_matrices(spark, tmp_path):
    r = str(tmp_path)
    put(f"{r}/o.csv", "name,aliases\nAlpha,Al; A1\nBeta,\n")
    assert {tuple(x) for x in R.variants(spark, f"{r}/o.csv").collect()} == {("Alpha", "Alpha"), ("Alpha", "Al"), ("Alpha", "A1"), ("Beta", "Beta")}
    put(f"{r}/o.yaml", "- {name: Alpha, aliases: [Al]}\n- {name: Beta}\n")
    assert R.variants_yaml(spark, f"{r}/o.yaml").count() == 3
    put(f"{r}/c.csv", "﻿name,code\nb,B\na,A\n")
    assert [x.code for x in R.codes(spark, f"{r}/c.csv").orderBy("ord").collect()] == ["B", "A"]
    put(f"{r}/m.csv", ",A,B\nA,1,1\nB,0,1\n")
    assert {tuple(x) for x in R.sub_matrix(R.matrix(spark, f"{r}/m.csv"), ["a", " B"]).collect()} == {("a", "a", 0), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)}
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(f"{r}/m.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>A</t></si><si><t>B</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>0</v></c><c r="C2"><v>1</v></c></row></sheetData></worksheet>')
    assert {tuple(x) for x in R.xlsx_matrix(spark, f"{r}/m.xlsx").collect()} == {("A", "A", "0"), ("A", "B", "1")}


def test_web_files(spark, tmp_path):
    r = str(tmp_path)
    put(f"{r}/p/1.html", '<meta charset="windows-1250">žlutý'.encode("cp1250"))
    assert R.pages(spark, f"{r}/p").first().html.endswith("žlutý")
    put(f"{r}/l/2020/B/meta/links.json", json.dumps({"external_links": [{"url": "http://a", "text": "t"}]}))
    assert R.links_json(spark, f"{r}/l").first().url == "http://a"
    put(f"{r}/s.xml", "<urlset><url><loc>a</loc><lastmod>2020-01-01T00:00</lastmod></url><url><loc>b</loc></url><url><loc>c</loc><lastmod>2010-01-01</lastmod></url></urlset>")
    assert {x.loc for x in R.sitemap(spark, f"{r}/s.xml", "2015-01-01").collect()} == {"a", "b"}
    put(f"{r}/robots.txt", "User-agent: *\nSitemap: http://x/s.xml\n")
    assert R.robots_sitemaps(spark, f"{r}/robots.txt").first().url == "http://x/s.xml"
    W.config_csv([{"a": 1}], {"k": 2}, f"{r}/k.csv")
    assert R.config_csv(f"{r}/k.csv") == ({"k": 2}, [{"a": "1"}])


def test_keyed_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    n = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id int, v string")
    assert {tuple(r) for r in W.upserted(t, n, ["id"], "v").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    q = W.quarantined(spark.createDataFrame([("x", "old", 2)], "doc_id string, error string, attempts long"), spark.createDataFrame([("x", "new"), ("y", "new")], "doc_id string, error string"))
    assert {tuple(r) for r in q.collect()} == {("x", "new", 3), ("y", "new", 1)}


def test_frontier_stream_is_idempotent(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    ddl = "id long, org_id long, url_key string, url string"
    spark.createDataFrame([(1, 1, "a", "http://a"), (2, 1, "a", "https://a"), (3, 2, "a", "http://a")], ddl).coalesce(1).write.parquet(src)
    run = lambda: S.run_frontier(spark.readStream.schema(ddl).parquet(src), out, f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([(4, 1, "a", "x"), (5, 1, "b", "http://b")], ddl).coalesce(1).write.mode("append").parquet(src)
    run()
    want = {(1, "a", 1), (2, "a", 3), (1, "b", 5)}
    assert {(r.org_id, r.url_key, r.id) for r in S.known(spark, out).collect()} == want
    last = max(r.batch for r in S.known(spark, out).collect())
    S.add_new(spark, out)(spark.createDataFrame([(5, 1, "b", "http://b")], ddl), last)
    assert {(r.org_id, r.url_key, r.id) for r in S.known(spark, out).collect()} == want


def test_streak_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(10).selectExpr("1L org_id", "timestamp_seconds(id) fetched_at", "id = 4 ok").coalesce(1).write.parquet(src)
    q = S.streaks(spark.readStream.schema("org_id long, fetched_at timestamp, ok boolean").parquet(src), 3).writeStream.format("memory").queryName("streaks").option("checkpointLocation", f"{tmp_path}/cp").start()
    end = time.time() + 60
    while spark.table("streaks").count() < 2 and time.time() < end:  # with a processing-time timeout the query has always another batch to run
        time.sleep(0.5)
    q.stop()
    assert [(r.streak, r.pause_s) for r in spark.table("streaks").orderBy("at").collect()] == [(3, 90), (3, 90)]


def test_raters_and_rules(spark):
    d = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, text string")

    def caller(text):
        if text == "bad":
            raise ValueError
        return "collaboration", 10, 2

    assert {(r.id, r.status) for r in S.rated(d, caller, "m").collect()} == {(1, "coded"), (2, "ERROR")}
    x = spark.createDataFrame([(1, "s", " a "), (2, "t", " b ")], "doc_id long, source string, text string")
    assert {r.text for r in S.ruled(x, {"s": [str.strip, str.upper]}).collect()} == {"A", " b "}
