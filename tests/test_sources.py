import gzip
import json

import pytest

from paralogic.sources import readers, writers


def put(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def test_csv_and_ragged(spark, tmp_path):
    f = put(tmp_path / "a.csv", 'a,b\n1,"x ""y"", z"\n2,\n')
    assert [tuple(r) for r in readers.csv(spark, f, "a int, b string").collect()] == [(1, 'x "y", z'), (2, None)]
    f = put(tmp_path / "r.csv", "1,2,3\n4\n")
    assert [tuple(r) for r in readers.ragged_csv(spark, f, 3).collect()] == [("1", "2", "3"), ("4", None, None)]


def test_jsonl_folder_falls_back_to_the_stem(spark, tmp_path):
    put(tmp_path / "one.jsonl", '{"model":"m","x":1}\n\n{"model":"","x":2}\n')
    put(tmp_path / "two.jsonl", '{"x":3}\n')
    put(tmp_path / "no.txt", '{"x":4}\n')
    got = {r["x"]: r["system"] for r in readers.jsonl_folder(spark, str(tmp_path), "model string, x int").collect()}
    assert got == {1: "m", 2: "one", 3: "two"}


@pytest.mark.parametrize("name,text,want", [
    ("s.txt", "one\n\n two \n", [("0", "one"), ("1", "two")]),
    ("s.json", '{"sentences": ["a", {"id": "k", "text": "b"}]}', [("0", "a"), ("k", "b")]),
    ("t.json", '["a", "b"]', [("0", "a"), ("1", "b")]),
    ("s.jsonl", '{"id":"q","sentence":"x"}\n{"text":"y"}\n', [("q", "x"), ("1", "y")]),
])
def test_sentences(spark, tmp_path, name, text, want):
    assert [tuple(r) for r in readers.sentences(spark, put(tmp_path / name, text)).collect()] == want


def test_eight_lines(spark, tmp_path):
    f = put(tmp_path / "q.txt", "".join(f"\n{a}\nctx {a}\nask?\nA.one\nB. two\nC.three\nD.four\n" for a in "bz") + "\nc\n")
    got = readers.eight_lines(spark, f).orderBy("at").collect()
    assert [(r["label"], r["context"], r["answers"]) for r in got] == [(1, "ctx b", ["one", "two", "three", "four"]), (0, "ctx z", ["one", "two", "three", "four"])]


def test_graph_corpus(spark, tmp_path):
    text = "# head\n# ::id 1 ::x\n# ::snt A b.\n(a / b\n   :r (c / d))\n\n# ::snt only\n\n(x / y)\n"
    with gzip.open(tmp_path / "g.txt.gz", "wt") as f:
        f.write(text)
    entries = readers.graph_corpus(spark, str(tmp_path / "g.txt.gz"))
    assert entries.count() == 3 and not [r for r in entries.collect() if "head" in r["entry"]]
    assert [tuple(r) for r in readers.sentence_and_graph(entries).collect()] == [("A b.", "(a / b :r (c / d))")]
    writers.graph_corpus(entries.coalesce(1), str(tmp_path / "out"))
    assert sorted(r["entry"] for r in readers.graph_corpus(spark, str(tmp_path / "out")).collect()) == sorted(r["entry"] for r in entries.collect())


def test_blocks_and_alignment(spark, tmp_path):
    (tmp_path / "u" / "v").mkdir(parents=True)
    put(tmp_path / "u" / "v" / "a.umr", "one\n" + "#" * 80 + "\n\n" + "#" * 80 + "\ntwo\n")
    assert sorted(r["block"] for r in readers.blocks(spark, str(tmp_path / "u")).collect()) == ["one", "two"]
    df = spark.createDataFrame([(" x0: 1-12 ",), ("x0: 1",)], "l string")
    got = [r[0] for r in df.select(readers.alignment(df.l)).collect()]
    assert tuple(got[0]) == ("x0", 1, 12) and got[1] is None


def test_paragraphs(spark, tmp_path):
    f = put(tmp_path / "p.txt", "A cat sat.\n0.9 (cat; sat)\n\nNo labels here\n---\nTwo here\n0.5 (a; b)\n0.4 Context(x)\n")
    got = {r["text"]: r["labels"] for r in readers.paragraphs(spark, f).collect()}
    assert got == {"A cat sat.": ["(cat; sat)"], "Two here": ["(a; b)", "Context(x)"]}


def test_json_readers(spark, tmp_path):
    f = put(tmp_path / "q.json", json.dumps([{"c": "x", "qs": [{"q": "1"}, {"q": "2"}]}]))
    rows = readers.exploded(readers.json_array(spark, f, "c string, qs array<struct<q:string>>"), "qs")
    assert [(r["c"], r["pos"], r["q"]) for r in rows.orderBy("pos").collect()] == [("x", 0, "1"), ("x", 1, "2")]
    (tmp_path / "d").mkdir()
    put(tmp_path / "d" / "7.txt", '{"a":\n 1}')
    got = readers.json_files(spark, str(tmp_path / "d"), "a int").collect()
    assert got[0]["a"] == 1 and got[0]["race_id"].endswith("7.txt")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "k int, v string")
    path = str(tmp_path / "t")
    writers.append(df.filter("k < 3"), path, ["k"])
    writers.append(df, path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    writers.vocabulary(df.groupBy(df.v.alias("token")).count().withColumnRenamed("count", "n"), str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["a\t2", "b\t1"]
    writers.line_files(df, {"k": str(tmp_path / "k1"), "v": str(tmp_path / "k2")}, "k")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "k1")).collect()) == ["1", "2", "3"]
    assert writers.markdown(df.filter("k = 1")) == "| k | v |\n| - | - |\n| 1 | b |"
    with pytest.raises(ValueError):
        writers.markdown(df, limit=2)
