import random

from paralogic.operators import corpus


def test_near_duplicate_rate_finds_all_and_joins_no_token_texts(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = ["", None, "a", "a"]
    for _ in range(60):
        base = rng.sample(words, rng.randint(1, 30))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            texts.append(" ".join(w for w in base if rng.random() > 0.1) + rng.choice(["", " x", " y z"]))
    rows = [(i // 2 if i > 150 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, set((t or "").split())) for i, t in rows]
    got = {r["threshold"]: r["n_dup"] for r in corpus.near_duplicate_rate(docs).collect()}
    assert got == {x: sum(any(j < i and s and t and len(s & t) / len(s | t) >= x for j, t in sets) for i, s in sets) for x in (0.8, 0.7)}
    members, nearest = corpus.nearest_classes(docs, (0.8, 0.7))
    assert "items" not in nearest._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_numbers_before_they_are_shuffled_and_meet_in_shares(spark, monkeypatch):
    shuffled, met = [], corpus.met_pairs
    monkeypatch.setattr(corpus, "met_pairs", lambda entries, t: shuffled.append(dict(entries.dtypes)) or met(entries, t))
    monkeypatch.setattr(corpus, "LISTED", 5)  # most tokens keep their hash
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "k l m n", "k l m n", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["threshold"]: r["n_dup"] for r in corpus.near_duplicate_rate(docs).collect()}
    assert got == {0.8: 2, 0.7: 2}
    assert len(shuffled) == corpus.PASSES and all(set(s.values()) == {"bigint"} for s in shuffled)
