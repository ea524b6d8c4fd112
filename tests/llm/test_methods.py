"""The dealt methods decide results: brute-force versions and edge cases on small tables."""

import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paralogic.llm import common, decontamination, html_text, license_scan, pii_pseudonyms, quality_classifier, quality_rules, simhash_dedup, source_mixing, substring_dedup

# ------------------------------------------------------------------ op1


def bm25_hits(items, words, half, threshold):
    """Items whose best part reaches the threshold in some passage, scored apart from the index."""
    parts = [(k, ws[i : i + half]) for k, ws in enumerate(items) for i in range(0, len(ws), half) if i == 0 or len(ws) - i >= half // 4]
    n, df = len(parts), Counter(w for _, ws in parts for w in set(ws))
    mean, out = sum(len(ws) for _, ws in parts) / n, set()
    for k, ws in parts:
        weights = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, tf in Counter(ws).items()}
        for at in range(0, max(1, len(words)), half):
            here = set(words[at : at + 2 * half])
            if sum(v for w, v in weights.items() if w in here) / sum(weights.values()) >= threshold:
                out.add(k)
    return out


def test_wand_equals_exhaustive_bm25():
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(250)]
    items = [" ".join(rng.choice(vocabulary, rng.integers(10, 150))) for _ in range(120)]
    index = decontamination.Index([(i, t, t) for i, t in enumerate(items)], half=32, block=3)
    split = [[w.encode() for w in t.split()] for t in items]
    for k in range(60):
        words = [str(w).encode() for w in [*rng.choice(vocabulary, 70), *items[k].split()[: rng.integers(5, 60)], *rng.choice(vocabulary, 30)]]
        got = {index.items[h[0]][0] for h in index.search([words], threshold=0.55, overlap=0.0)[0]}
        assert got == bm25_hits(split, words, 32, 0.55)


def test_verification_needs_question_and_answer():
    question, answer = "Which old bridge crosses the wide river near the quiet town of stone", "It is the narrow iron bridge that the miller built long ago"
    index = decontamination.Index([(1, question, answer)])
    texts = [f"{question} {answer}", question, answer, " ".join(reversed(f"{question} {answer}".split()))]
    hits = index.search([decontamination.tokens(t) for t in texts], threshold=0.3)
    assert [bool(h) for h in hits] == [True, False, False, False]


def test_long_text_is_searched_in_segments():
    item = " ".join(f"needle{i}" for i in range(40))
    index = decontamination.Index([(5, item, item)])
    filler = " ".join(f"hay{i % 1000}" for i in range(60_000))
    texts = pa.array([f"{filler} {item} {filler} {item}", None, "", filler, item, item])
    found = dict(decontamination.row_hits(texts, index, 0.6, 0.6))
    assert set(found) == {0, 4, 5} and all(len(h) == 1 for h in found.values())
    whole = dict(decontamination.row_hits(texts[4:], index, 0.6, 0.6))
    assert set(whole) == {0, 1}
    small = [s for s in decontamination.segments(texts, index, most=5_000)]
    assert max(sum(len(w) for *_, w in part) for part in small) < 70_000
    assert b" ".join(w for ws in decontamination.word_stream(memoryview(filler.encode())) for w in ws).decode() == filler


def test_leaks_of_repeated_rows_and_clashing_names(spark):
    item = "Where does the quiet river turn before it meets the old stone bridge? It turns north beside the ruined mill and the orchard wall."
    docs = spark.createDataFrame([(1, item, "a"), (1, item, "a"), (None, item, "b"), (2, "x" * 100_000, "c")], "doc_id long, text string, item_id string")
    found = decontamination.leaks(docs, spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["item_id"]) for r in found) == [(False, 1, 7), (False, 1, 7), (False, 1, 8), (False, 1, 8), (True, 0, 7), (True, 0, 8)]


# ------------------------------------------------------------------ op2


def feistel(digits, key, kind):
    """The digit permutation, step by step."""
    n = len(digits)
    nl = -(-n // 2)
    left, right = int(digits[:nl]), int(digits[nl:] or 0)
    for i in range(1, pii_pseudonyms.ROUNDS + 1):
        import hashlib

        mix = lambda v: int(hashlib.sha256(f"{key}|{kind}{n}|{i}|{v}".encode()).hexdigest()[:13], 16)  # noqa: B023, E731
        if i % 2:
            left = (left + mix(right)) % 10**nl
        else:
            right = (right + mix(left)) % 10 ** (n - nl)
    return f"{left:0{nl}d}{right:0{n - nl}d}"


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10


def test_pseudonyms_of_cards_in_runs_phones_and_ibans(spark):
    texts = ["card 4111 1111 1111 1111 12/26", "4111 1111 1111 1111 123", "in 2024 4111 1111 1111 1111 was", "521-555-6210", "(521) 555-6210", "+1 (017) 555-7713", "GB29 NWBK 6016 1331 9268 19", "03/25/2020", "02/29/2000", "a 2024 521-555-6210"]
    got = [r["text"] for r in pii_pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    body = feistel("411111111111111", "k", "card")
    card = body + str((10 - luhn(body + "0")) % 10)
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    assert got[:3] == [f"card {spaced} 12/26", f"{spaced} 123", f"in 2024 {spaced} was"]
    phone = feistel("5215556210", "k", "phone1/")
    assert got[3] == f"{phone[:3]}-{phone[3:6]}-{phone[6:]}" and got[4] == f"({phone[:3]}) {phone[3:6]}-{phone[6:]}" and got[9] == "a 2024 " + got[3]
    other = feistel("0175557713", "k", "phone1/")
    assert got[5] == f"+1 ({other[:3]}) {other[3:6]}-{other[6:]}"
    plain = got[6].replace(" ", "")
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[6]) and plain[4:] != "NWBK60161331926819" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.fullmatch(r"\d\d/(1[3-9]|2[0-8])/\d{4}", got[7]) and got[8].startswith("02/29/") and got[7] != texts[7]
    with pytest.raises(ValueError):
        pii_pseudonyms.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), "")


def test_pseudonyms_survive_adversarial_texts(spark):
    m = 1_000_000
    texts = ["x@" + "a." * (m // 2), "a." * (m // 2) + "@b.cc", "1" * m, "GB29 " + "ABCD " * (m // 5), "+1 " + "(23)" * (m // 4), "01/" * (m // 3), "1." * (m // 2), "- " * (m // 2)]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, None, "same 10.0.0.1", "same 10.0.0.1"])], "doc_id long, text string, found string")
    got = {r["doc_id"]: r["text"] for r in pii_pseudonyms.pseudonymised(rows, "k").collect()}
    assert [got[i] for i in (0, 2, 3, 5, 6, 7)] == [texts[i] for i in (0, 2, 3, 5, 6, 7)] and got[8] is None and got[9] == got[10] != "same 10.0.0.1"
    assert pii_pseudonyms.pseudonymised(rows.limit(0), "k").count() == 0


# ------------------------------------------------------------------ op3


def test_limits_differ_by_group_and_decide(spark):
    short, long = " ".join(["ab", "cde", "fg", "hij"] * 10), " ".join(["abcdefghij", "klmnopqrstu", "vwxyzabcd"] * 13)
    words = lambda base, i: " ".join(f"{w}{chr(97 + (i * 7 + k * 3) % 26)}{chr(97 + k % 26)}" for k, w in enumerate(base.split()[:30]))
    rows = [(i, words(short, i), "en", "a") for i in range(400)] + [(400 + i, words(long, i), "en", "b") for i in range(400)] + [(900, words(long, 1), "en", "a"), (901, words(short, 1), "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.adaptive_filter(docs).collect()}
    assert not kept[900] and not kept[901] and all(kept[i] for i in range(800))
    measured = quality_rules.measured(docs, ["doc_id", "lang", "source"])
    found = {r["source"]: r for r in quality_rules.limits(common.cut(quality_rules.sketches(measured))).collect()}
    assert found["a"]["word_len_high"] < found["b"]["word_len_high"] and found["a"]["word_len_low"] < found["b"]["word_len_low"]


def test_quality_rules_on_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", None, 2), (1, "", "en", None, 2), (2, "w " * 50_000, "en", "s", 3)], "doc_id long, text string, lang string, source string, kept long")
    got = quality_rules.adaptive_filter(docs).collect()
    assert len(got) == 4 and not any(r["kept"] for r in got)


# ------------------------------------------------------------------ op4

LONG = "some words of a longer paragraph " * 5


def brute_stretches(weights, threshold, window):
    """Lines of every window that reaches the threshold."""
    on = set()
    for i in range(len(weights)):
        if sum(weights[i : i + window]) >= threshold:
            on |= set(range(i, min(len(weights), i + window)))
    return on


def test_stretches_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        weights = [int(x) for x in rng.choice([0, 0, 5, 30, 90], rng.integers(1, 25))]
        window, threshold = int(rng.integers(1, 5)), int(rng.integers(10, 120))
        sums = [sum(weights[i : i + window]) for i in range(len(weights))]
        on = {k for a, b in html_text.stretches(sums, threshold, window) for k in range(a, b)}
        assert on == brute_stretches(weights, threshold, window)


def test_surge_and_window_change_the_result():
    page = html_text.lines_of(f"<p>{LONG}</p><div><p>one</p></div><div><p>two</p></div><div><p>three</p></div><div><p>four</p></div><p>{LONG}</p>")
    results = {(w, s): tuple(html_text.between(page, w, s)) for w in (1, 3, 6) for s in (1, 80)}
    assert len(results[1, 1]) == 6 and len(results[1, 80]) == 2 and len(results[6, 80]) == 6


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<div><ul><li><a href=1>Home</a></li><li><a>About us</a></li></ul></div><div><h1>Title</h1><p>{LONG}</p><p>short.</p><div class=ad>buy</div><p>fin</p></div><div>Made by us</div>", f"Title\n{LONG.strip()}\nshort.\nfin"),
        (f"<article><p>tiny</p></article><div>{LONG * 6}</div><div>side</div>", f"tiny\n{(LONG * 6).strip()}"),
        ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a x b"),
        ("plain <b text", "plain <b text"),
    ],
)
def test_pages_without_marks(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("piece", ['<a"', "<a '\">", "<!", "<div>", "</div>", '<b class="', "<svg>", "<p>" + "y" * 100 + "</p><nav></nav>"])
def test_pages_are_read_in_linear_time(piece):
    began = time.time()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 30


def test_extract_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ------------------------------------------------------------------ op5


def dice(a, b):
    a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_notices_in_sentences_and_full_texts(spark):
    full = {k: "\n\n".join(parts) for k, parts in license_scan.FULL}
    texts = ["Read this. This project is released under the MIT License. See LICENSE.", "Copyright 2020 Jane Doe. Released under the MIT License.", "Title\n\n" + full["MIT"], "x\n" + full["BSD-2-Clause"], full["Unlicense"].replace("\n\n", " "), "It is mit dem Zug " * 50, None]
    got = {}
    for r in license_scan.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got[0] == got[1] == {"MIT"} and "MIT" in got[2] and "BSD-2-Clause" in got[3] and "Unlicense" in got[4] and not {5, 6} & set(got)


def test_anchors_lose_no_unit():
    words = sorted({w for _, _, _, grams in license_scan.templates() for g in grams for w in g.split()})
    gate, rng = re.compile(license_scan.gate(0.8)), np.random.default_rng(6)
    texts = [t for k, t in license_scan.TEXTS] + [" ".join(parts) for _, parts in license_scan.FULL] + [p.format(n) for ns in license_scan.NAMES.values() for n in ns for p in license_scan.PHRASES]
    for t in texts:
        base = license_scan.normal(t)
        for _ in range(15):
            unit = [str(rng.choice(words)) if rng.random() < 0.12 else w for w in base if rng.random() > 0.05]
            if dice(unit, base) >= 0.8:
                assert gate.search(" ".join(unit))


# ------------------------------------------------------------------ op7 and its stage


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_equals_brute_force_and_keeps_columns(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(25):
        base = [f"w{i}" for i in rng.integers(0, 5000, 80)]
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 12)):
            other = list(base)
            for k in rng.choice(80, rng.integers(0, 4), replace=False):
                other[k] = f"z{rng.integers(0, 9999)}"
            texts.append(" ".join(other))
    rows = [(i, t, "en", "s", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row long")
    got = simhash_dedup.keep_one(spark, docs, "")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


# ------------------------------------------------------------------ op8


def test_repeats_are_cut_on_character_borders(spark):
    passage = " ".join(f"größe{i}übung" for i in range(60))
    docs = spark.createDataFrame([(1, f"erster Anfang {passage} Ende", "x"), (2, f"ganz anderer Anfang hier {passage} Schluß", "y"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, _row string")
    got = {(r["doc_id"], r["_row"]): r["text"] for r in substring_dedup.deduplicated(docs).collect()}
    assert got[1, "x"] == f"erster Anfang {passage} Ende" and got[2, "z"] is None and got[3, "z"] == ""
    assert got[2, "y"].startswith("ganz anderer Anfang") and got[2, "y"].endswith("Schluß") and len(got[2, "y"]) < len(passage) / 2
    data = "ä€𝄞ß".encode() * 500
    ends = substring_dedup.chunks(data)
    assert b"".join(data[a:b] for a, b in zip([0, *ends], ends)) == data and all(data[a:b].decode() for a, b in zip([0, *ends], ends))


def test_first_occurrence_of_ties_stays(spark):
    passage = " ".join(f"tie{i * i % 97}word" for i in range(60))
    got = substring_dedup.repeated_spans(spark.createDataFrame([(4, passage), (4, passage), (4, passage)], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r["repeated_bytes"] == len(passage) for r in got)


# ------------------------------------------------------------------ op9


def test_repeated_rows_follow_the_mix(spark):
    rows = [(i, "word " * (i % 9 + 1) if i % 10 else None, f"s{i % 3}", i, "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, size string")
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in source_mixing.mixed(docs.drop("row", "size")).collect()}
    got = Counter(r["doc_id"] for r in source_mixing.repeated(docs).collect())
    assert source_mixing.repeated(docs).columns == docs.columns
    sums = lambda f: {s: sum(f(i) for i in range(300) if i % 3 == s) for s in range(3)}
    assert sums(lambda i: got[i] * (i % 9 + 1) * bool(i % 10)) == sums(lambda i: taken[i][0]) and not any(got[i] for i in range(0, 300, 10))
    assert source_mixing.repeated(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ op10


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(1)
    x, owner, y = rng.normal(size=(12, 5)).astype(np.float64), np.repeat([0, 1, 2, 3], 3), np.array([0, 1, 1, 0])
    start = quality_classifier.train(x, owner, y, hidden=4, gate=3, steps=0)

    def loss(model):
        p = model.forward((x - model.mean) / model.scale, owner, 4)["p"]
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    slow, fast = loss(quality_classifier.train(x, owner, y, hidden=4, gate=3, steps=3)), loss(quality_classifier.train(x, owner, y, hidden=4, gate=3, steps=60))
    assert fast < slow < loss(start)


def test_one_bad_passage_draws_the_attention():
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice([f"w{i}" for i in range(300)], 64))
    bad = lambda: " ".join(w + "###" for w in good().split())
    texts, y, place = [], [], []
    for k in range(240):
        parts = [good() for _ in range(8)]
        if k % 2:
            place.append(int(rng.integers(8)))
            parts[place[-1]] = bad()
        texts.append(" ".join(parts).encode())
        y.append(1 - k % 2)
    encoder = quality_classifier.Encoder()
    x, owner = encoder.encode(texts)
    model = quality_classifier.train(x[: 8 * 160], owner[: 8 * 160], np.array(y[:160]))
    f = model.forward((x - model.mean) / model.scale, owner, 240)
    held = range(161, 240, 2)
    assert all((f["p"][k] >= 0.5) == y[k] for k in range(160, 240))
    weights = f["a"].reshape(240, 8)
    assert np.mean([weights[k].argmax() == place[k // 2] for k in held]) > 0.9 and np.mean([weights[k].max() for k in held]) > 2 / 8


def test_training_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " + "word " * (i % 300)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (quality_classifier.sample_features(docs.repartition(k), labels, max_passages=30) for k in (2, 5))
    assert one == two and 0 < sum(len(r[2]) for r in one) <= 30 * quality_classifier.WIDTH * 2


# ------------------------------------------------------------------ shared


def test_places_are_stable_and_free_of_clashes(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").withColumn("p_at", F.lit(1))
    one, two = ({(r["id"], r["p"]) for r in common.with_place(rows, "p").collect()} for _ in range(2))
    assert one == two and len({p for _, p in one}) == 100
    kept = common.stored(spark.range(5), "spent")
    common.discard(kept)
    assert not kept.inputFiles() or pytest.raises(Exception, kept.count)


def test_pipeline_stages_equal_brute_force(spark):
    """Every stage's kept rows on the smallest tables, against plain versions of its decision."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.select(*(c for c in ("doc_id", "text", "source") if c in docs.columns)).collect()}
        docs = common.stored(stage(spark, docs, d), name)
        seen[name] = (before, [r["doc_id"] for r in docs.collect()])
    model = quality_classifier.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    before, kept = seen["quality_classifier"]
    assert sorted(kept) == sorted(i for i, r in before.items() if model.scores(*quality_classifier.Encoder().encode([(r["text"] or "").encode()]), 1)[0] >= 0.3)
    before, kept = seen["simhash_near_dedup"]
    ids = sorted(before)
    root = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if root[i] != root[j] and jaccard(before[i]["text"], before[j]["text"]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert sorted(kept) == sorted(set(root.values()))
    before, kept = seen["benchmark_decontamination"]
    squeeze = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    bench = [squeeze(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if r["text"]]
    assert not [i for i in kept if any(b in squeeze(before[i]["text"]) for b in bench)]
    before, kept = seen["source_mixing"]
    sizes = {i: len(r["text"].split()) for i, r in before.items()}
    assert max(Counter(kept).values()) <= 2 and abs(sum(sizes[i] for i in kept) - 1.5 * sum(sizes.values())) < 0.5 * sum(sizes.values())
    assert sorted(seen["token_output"][1]) == sorted(kept)
