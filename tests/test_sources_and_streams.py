"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from corpuslab.session import clean, materialise
from corpuslab.sources import model, readers, sinks
from corpuslab.streaming import streams


def test_catalogue(spark, tmp_path):
    path = tmp_path / "chapters.csv"
    path.write_text("﻿n,name,title,kind,ch,author,chapter,ref\n1,one,One,k,0,A,,r\n1,one,One,k,1,B,First,c1\n2,,,,3,C,Orphan\n0,x,x,x,0,,,\nbad,x,x,x,1,,,\n", encoding="utf-8")
    books, chapters = readers.catalogue(spark, str(path))
    assert {(r["book_number"], r["book_name"]) for r in books.collect()} == {(1, "one"), (2, "")}
    assert {(r["book_number"], r["chapter_number"], r["title"]) for r in chapters.collect()} == {(1, 1, "First"), (2, 3, "Orphan")}


def test_html(spark):
    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><script>x</script><h1>Head</h1><p>a&lt;b</p><!-- no --><p>c</p></body></html>"
    row = readers.parse_pages(spark.createDataFrame([(1, page)], "page_id int, html string")).first()
    assert row["headings"] == ["Head"]
    assert "a<b" in row["text"]
    assert "no" not in row["text"]


def test_files(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"3": {"a": 1, "b": "x"}, "4": {"a": 2, "b": None}}))
    assert {tuple(r) for r in readers.keyed_json(spark, str(tmp_path / "o.json"), "id", "struct<a:int,b:string>").collect()} == {("3", 1, "x"), ("4", 2, None)}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    assert readers.file_facts(spark, str(tmp_path / "l.jsonl")).first()["length"] == 19
    names = spark.createDataFrame([("journal_2006_v1_i2_a_title.pdf",), ("other.pdf",)], "n string")
    assert [r[0].title if r[0] else None for r in names.select(readers.name_parts(F.col("n"))).collect()] == ["a title", None]


def test_schema_evolution(spark, tmp_path):
    old = spark.createDataFrame([("7", "A title", 3)], "number string, title string, words int")
    sinks.parquet(old, str(tmp_path / "chapters"))
    row = model.load(spark, str(tmp_path / "chapters"), "chapters", {"number": "chapter_number"}).first()
    assert (row["chapter_number"], row["title"], row["words"], row["text"]) == (7, "A title", 3, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a " * 20, [1.0])], "citation_id int, body_text string, from_vector array<double>")
    sinks.json_mirror(df, str(tmp_path / "mirror"))
    assert len(spark.read.json(str(tmp_path / "mirror")).first()["body_text"].split()) == 10
    sinks.pairs(df, str(tmp_path / "pairs"), ("from_vector",))
    assert spark.read.parquet(str(tmp_path / "pairs/vectors")).count() == 1
    for _ in range(2):
        sinks.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_log_stream_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1, "timestamp": "2024-01-01T00:00:00", "question": "q"}\n')
    log = lambda: streams.query_log(spark, str(tmp_path / "in"), "id int, timestamp string, question string")
    for _ in range(2):
        streams.append_log(log(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_conversation_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "clear" if i == 10 else "x") for i in range(12)]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "turn", "role", "text"), t, strict=True))) for t in turns))
    rows = spark.readStream.schema("conv_id long, turn long, role string, text string").json(str(tmp_path / "in"))
    q = streams.conversation_state(rows).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = {r["turn"]: r["kept"] for r in spark.table("kept").collect()}
    assert [kept[i] for i in range(12)] == [1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 0, 1]


def test_incremental_fill(spark, tmp_path):
    spark.range(3).selectExpr("id", "'t' as text").write.json(str(tmp_path / "in"))
    work = lambda df: df.select("id", F.upper("text").alias("summary"))
    for i in range(2):
        units = spark.readStream.schema("id long, text string").json(str(tmp_path / "in"))
        streams.fill_incrementally(units, str(tmp_path / "out"), ["id"], work, str(tmp_path / f"cp{i}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_windows_of_stream_and_batch_agree(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 00:10:00"), (1, "a", 2.0, "2024-01-01 23:00:00"), (2, "b", 3.0, "2024-01-02 01:00:00")], "user_id int, event_type string, value double, t string")
    events = events.select("user_id", "event_type", "value", F.to_timestamp("t").alias("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = streams.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), late="1 day")
    stream.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("wins").collect()} == {tuple(r) for r in streams.tumbling(events).collect()}
    assert streams.sessions(events).count() == 3


def test_work_folder(spark):
    kept = materialise(spark.range(5).toDF("id"), "numbers")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    path = kept.inputFiles()[0].removeprefix("file://")
    clean(spark)
    import os

    assert not os.path.exists(path)
