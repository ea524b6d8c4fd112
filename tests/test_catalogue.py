import duckdb
import pytest

from paralogic.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(map(tuple, pdf[names].astype(object).where(pdf[names].notna(), "~").astype(str).values))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR).toPandas()
    assert rows(got) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def test_tie_goes_to_the_first_voter_and_is_reviewed(spark):
    from paralogic.operators.verdicts import consensus

    df = spark.createDataFrame([(1, 0, "a", "NOT_EQUIVALENT", 0.5), (1, 1, "b", "EQUIVALENT", 0.9), (2, 0, "a", "UNKNOWN", 0.3)], "id int, pos int, verifier string, label string, confidence double")
    got = {r["id"]: r for r in consensus(df, ["id"]).collect()}
    assert got[1]["majority"] == "NOT_EQUIVALENT" and got[1]["needs_review"] and got[1]["confidence"] == 0.25
    assert got[2]["majority"] == "UNKNOWN" and got[2]["confidence"] == 0 and got[2]["needs_review"]
