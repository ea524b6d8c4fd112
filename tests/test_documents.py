import pytest
from pyspark.sql import functions as F

from paralogic.functions import scores
from paralogic.operators import documents, rules
from paralogic.sources import readers

BLOCK = """# :: snt1
Index: 1 2
Words: He ran home
POS: PRP VBD RB

# sentence level graph:
(s1r / run-02
    :ARG0 (s1p / person
        :name (s1n / name :op1 "Ann"))
    :aspect performance
    :polarity -)

# alignment:
s1r: 2-2

# document level annotation:
(s1s0 / sentence
    :temporal ((document-creation-time :before s1r) (s1r :after s2r))
    :modal ((author :full-affirmative s1r)))"""


def test_blocks_attributes_and_annotations(spark):
    df = spark.createDataFrame([("f", BLOCK), ("f", "# :: snt2\nEnglish translation: no graph"), ("f", "# :: snt3\nEnglish translation: two words\n# sentence level graph:\n(x / go-01)")], "file string, block string")
    rows = {r["sent_id"]: r for r in documents.parsed_blocks(df).collect()}
    assert set(rows) == {"snt1", "snt3"} or set(rows) == {"1", "3"}
    one, three = (rows[k] for k in sorted(rows))
    assert one["text"] == "He ran home" and one["pos_tags"] == ["PRP", "VBD", "RB"] and one["alignment"] == ["s1r: 2-2"] and three["text"] == "two words"
    got = documents.parsed_blocks(df).select(documents.attribute_values(F.col("graph"), "aspect").alias("a"), documents.annotated_relations(F.array_join("document", "\n"), "temporal").alias("t"), documents.annotated_relations(F.array_join("document", "\n"), "coref").alias("c")).collect()
    first = next(r for r in got if r["a"])
    assert first["a"] == {"s1n": "performance"} and [tuple(x) for x in first["t"]] == [("document-creation-time", ":before", "s1r"), ("s1r", ":after", "s2r")] and first["c"] == []


def test_relations_of_a_document(spark):
    rows = [("1", 0, "r", ":instance", "run-02"), ("1", 1, "r", ":ARG0", "p"), ("1", 2, "p", ":instance", "person"), ("1", 3, "p", ":name", "n"), ("1", 4, "n", ":op1", '"Ann"'),
            ("2", 0, "g", ":instance", "go-02"), ("2", 1, "g", ":polarity", "-"), ("2", 2, "g", ":ARG0", "q"), ("2", 3, "q", ":name", "m"), ("2", 4, "m", ":op1", '"Ann"')]
    graphs = rules.pack(spark.createDataFrame(rows, "graph_id string, pos int, source string, role string, target string"))
    got = documents.relations(graphs.select(F.lit("d").alias("doc"), F.col("graph_id").alias("pos"), F.concat(F.lit("s"), "graph_id", F.lit("_")).alias("prefix"), "top", "g"))
    assert {(r["src"], r["rel"], r["tgt"]) for r in got.collect()} == {("author", ":full-affirmative", "s1_r"), ("author", ":full-negative", "s2_g"), ("document-creation-time", ":before", "s1_r"), ("document-creation-time", ":before", "s2_g"), ("s1_r", ":before", "s2_g"), ("s1_p", ":same-entity", "s2_q")}


def test_repaired_text_metadata_and_collation(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# ::id x1 ::date\n# ::alignments 0-1 2-1.1\n(a / b)\n\n# ::id x2\n(c / d\x92s “é”)\n", encoding="utf-8")
    (tmp_path / "e.txt").write_text("\n")
    raw = [r["entry"] for r in readers.raw_graph_corpus(spark, f"{tmp_path}/a.txt").collect()]
    assert raw[1].endswith("(c / d's e)")
    gold = readers.gold_alignments(readers.graph_corpus(spark, f"{tmp_path}/a.txt"), expected=2).collect()
    assert [(r["id"], r["alignments"]) for r in gold] == [("x1", ["0-1", "2-1.1"]), ("x2", [])]
    assert [r["source"] for r in readers.collated(spark, [f"{tmp_path}/a.txt"] * 2).collect()] == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        readers.collated(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/e.txt"])
    rows = spark.createDataFrame([("b", "r1"), ("a", "r1"), ("c", "r2")], "id string, rule string")
    assert [r["id"] for r in readers.chosen(rows, rules=["r1"], limit=1).collect()] == ["a"]


def bleu(cand, ref):
    import math
    from collections import Counter

    total = used = 0
    power = 1
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (cand, ref))
        if not a:
            continue
        hit, size = sum((a & b).values()), sum(a.values())
        if n == 1 and not hit:
            return 0.0
        if not hit:
            power *= 2
        total, used = total + math.log(hit / size if hit else 1 / (power * size)), used + 1
    return 100 * math.exp(total / used) * (math.exp(1 - len(ref) / len(cand)) if len(cand) < len(ref) else 1) if used else 0.0


def test_sentence_bleu(spark):
    pairs = [("the cat sat on the mat", "the cat sat on a mat today"), ("a b c", "a b c"), ("x", "y z"), ("one two", "two one one"), ("", "a")]
    df = spark.createDataFrame([(a.split(), b.split()) for a, b in pairs], "a array<string>, b array<string>")
    got = [r["s"] for r in df.select(scores.sentence_bleu(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([bleu(a.split(), b.split()) for a, b in pairs])


def test_readability_rounds_as_its_sql_does(spark):
    # 0.39 * 5 / 2 + 11.8 * 48 / 5 - 15.59 is 98.66499999999999 as a double, a hundredfold 9866.5
    row = spark.range(1).select(scores.reading_ease(F.lit(5), F.lit(2), F.lit(20), F.lit(48)).alias("r")).select("r.*").first()
    assert row.flesch_kincaid == 98.67
