import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_engine.operators import fusion as R, lexical as L, logs, semantic as S

RECORDS = "id long, name string, path string, content string"
ROWS = [(1, "devis_cuisine.pdf", "Docs/Travaux", "le devis de la cuisine"), (2, "facture.pdf", "Docs", "cuisine cuisine facture"), (3, "photo.jpg", "Pictures", None), (4, "devi.txt", "Docs", "")]


@pytest.fixture(scope="module")
def index(spark):
    return L.build(spark.createDataFrame(ROWS, RECORDS))


def test_bm25_by_hand(spark, index):
    got = {r.doc_id: r.score for r in L.search(index, spark.createDataFrame([(1, "cuisine ")], "qid long, text string"), L.Weights(0, 0, 1.0)).collect()}
    docs = {1: "le devis de la cuisine".split(), 2: "cuisine cuisine facture".split()}
    mean, idf = sum(map(len, docs.values())) / 4, math.log(1 + (4 - 2 + 0.5) / 2.5)
    for i, words in docs.items():
        tf = Counter(words)["cuisine"]
        assert got[i] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)))
    assert set(got) == {1, 2}


def test_similar_and_longer_terms(spark, index):
    found = lambda q: {r.doc_id for r in L.search(index, spark.createDataFrame([(1, q)], "qid long, text string"), L.Weights(content=0)).collect()}
    assert found("devsi") == {1, 4}  # a swap of neighbours, and a deletion
    assert found("devi") == {1, 4}  # the word being typed
    assert found("devi ") == {4}  # typed to its end
    assert found("  ") == set()


def test_one_edit(spark):
    pairs = [("abcde", "abcde"), ("abcde", "abcd"), ("abcde", "abXde"), ("abcde", "abdce"), ("abcde", "abcdef"), ("abcde", "edcba"), ("abcde", "abc")]
    terms, vocabulary = spark.createDataFrame([("abcde",)], "term string"), spark.createDataFrame([(b,) for _, b in pairs], "found string")
    assert {r.found for r in L.similar_terms(terms, vocabulary).collect()} == {"abcde", "abcd", "abXde", "abdce", "abcdef"}


def test_upsert_and_delete(spark, index):
    changed = L.upsert(index, spark.createDataFrame([(1, "plan.pdf", "Docs", "plan"), (9, "new.pdf", "", "neuf")], RECORDS))
    assert changed.docs == 5
    assert {r.term for r in changed.postings.where("doc_id = 1 and field = 'content'").collect()} == {"plan"}
    assert L.delete(changed, spark.createDataFrame([(9,), (77,)], "id long")).docs == 4


def test_saved_index(spark, index, tmp_path):
    L.save(index, str(tmp_path))
    again = L.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "devis cuisine"), (2, "facture")], "qid long, text string")
    rows = lambda i: sorted((r.qid, r.doc_id, round(r.score, 9)) for r in L.search(i, asked).collect())
    assert rows(again) == rows(index) and again.docs == 4
    plan = again.postings.where("field = 'name' and term = 'devis'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "EqualTo(term,devis)" in plan


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    q = rng.integers(-127, 128, (200, 8))
    q[5] = 0
    rows = [(i, i // 3, i % 3 == 0, q[i].tolist()) for i in range(200)] + [(500, -1, False, q[0].tolist()), (501, 7, False, None)]
    vectors = spark.createDataFrame(rows, "row long, file_id long, is_name boolean, q array<int>").withColumn("q", F.col("q").cast("array<tinyint>"))
    asked = spark.createDataFrame([(1, q[3].tolist()), (2, [0] * 8)], "qid long, q array<int>")
    got = S.top_rows(S.searchable(vectors), asked, 5).orderBy(F.desc("cos"), "row").collect()
    cos = q @ q[3] / (np.maximum(np.linalg.norm(q, axis=1), 1e-9) * np.linalg.norm(q[3]))
    best = sorted(range(200), key=lambda i: (-round(cos[i], 6), i))[:5]
    assert [r.row for r in got] == best and got[0].cos == pytest.approx(1)
    files = S.per_file(S.top_rows(S.searchable(vectors), asked, 200)).collect()
    assert len({r.file_id for r in files}) == len(files) and min(r.rank for r in files) == 0


def test_quantise_halves_to_even(spark):
    q, scale = S.quantise(F.col("v"))
    r = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0, 0.0],)], "v array<double>").select(q.alias("q"), scale.alias("s")).collect()
    assert list(r[0].q) == [64, -127, 32] and list(r[1].q) == [0, 0, 0] and r[1].s > 0


def test_fusion_and_margin(spark):
    lex = spark.createDataFrame([(1, 10, 0.0, 0), (1, 11, 0.0, 1)], "qid long, doc_id long, score double, rank int")
    sem = spark.createDataFrame([(1, 11, 0.9, 5, 3, 0), (1, 12, 0.88, 6, 1, 1), (1, 13, 0.5, 7, 1, 2)], "qid long, file_id long, cos double, best_row long, near long, rank int")
    got = {r.id: r for r in R.cut_margin(R.fuse(lex, sem)).collect()}
    assert set(got) == {10, 11, 12}
    assert got[11].score == pytest.approx(1 / 22 + 1.1 / 21) and got[10].score == pytest.approx(1 / 21)
    shuffled = {r.id: r.score for r in R.fuse(lex.orderBy(F.desc("rank")), sem).collect()}
    assert all(shuffled[i] == pytest.approx(got[i].score) for i in got)


def test_signals_floor_and_order(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, 0, None), (1, 2, 1.0, 1, None)], "qid long, id long, score double, lex_rank int, sem_rank int")
    files = spark.createDataFrame([(1, "a (1).pdf", "pdf", "", "archive/1/2/3/4/5/6/7/8/9", 0.0, 0.0, None), (2, "b.pdf", "pdf", "", "", 1e9, 1e9, 1e9)], "id long, name string, ext string, root string, rel_parent string, mtime double, ctime double, last_used double")
    asked = spark.createDataFrame([(1, "zzz", ["txt"], 5.0, 6.0, None, "", False)], "qid long, text string, exts array<string>, date_from double, date_to double, year_hint int, name_terms string, recent boolean")
    got = {r.id: r for r in R.signals(hits, files, asked, 1e9).collect()}
    assert got[1].bonus == pytest.approx(-0.15 - 0.1 - 0.02 * 4 - 0.2 - 0.2, abs=1e-6)
    assert got[2].bonus == pytest.approx(0.3 - 0.4) and got[2].score == pytest.approx(0.9)
    low = R.signals(hits, files, asked, 1e9, R.Options(date_out=2.0)).where("id = 1").first()
    assert low.score == pytest.approx(0.05)


def test_rerank_moves_the_head_only(spark):
    hits = spark.createDataFrame([(1, i, i) for i in range(5)], "qid long, id long, place int")
    scores = spark.createDataFrame([(1, 0, -9.0), (1, 1, 9.0), (1, 4, 9.0)], "qid long, id long, logit double")
    got = {r.id: r.final_rank for r in R.rerank(hits, scores, R.Options(rerank_top=2)).collect()}
    assert got == {1: 0, 0: 1, 2: 2, 3: 3, 4: 4}


def test_options():
    name, o = R.Options.variant("fast=rrf_k:10,signals:no,limit:5")
    assert (name, o.rrf_k, o.signals, o.limit) == ("fast", 10.0, False, 5)
    with pytest.raises(ValueError, match="no option"):
        R.Options.variant("x=nothing:1")


def test_use(spark):
    clicks = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-01', 'Facture EDF', 7L), (1L, TIMESTAMP'2024-01-01', 'Facture EDF', 7L), (2L, TIMESTAMP'2020-01-01', 'facture', 7L), (3L, TIMESTAMP'2024-01-01', '', 8L) AS t(id, ts, query, file_id)")
    now = 1704067200.0 + 30 * 86400
    asked = spark.createDataFrame([(1, "factu"), (2, "fac"), (3, "facture edf "), (4, "")], "qid long, text string")
    assert {r.id: round(r.general, 6) for r in logs.general_use(clicks, now).collect()} == {7: round(0.3 / math.e, 6), 8: round(0.3 / math.e, 6)}
    assert {(r.qid, r.id): r.specific for r in logs.specific_use(clicks, asked, now).collect()} == {(1, 7): 0.5, (3, 7): 0.5}


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_bounded_sums_keep_the_best(spark, limit):
    rng = random.Random(limit)
    scores = [(f"w{w}", False, d, round(rng.random() * (8 - w), 2)) for w in range(8) for d in range(300) if rng.random() < 0.1 + w * 0.1]
    asked = [(q, f"w{w}", False) for q in range(30) for w in rng.sample(range(8), 1 + q % 5)] + [(99, "nowhere", False)]
    by_word, sums = {}, {}
    for w, _, d, s in scores:
        by_word.setdefault(w, []).append((d, s))
    for q, w, _ in asked:
        for d, s in by_word.get(w, ()):
            sums[q, d] = sums.get((q, d), 0) + s
    got = {(r.qid, r.doc_id): r.score for r in L.best_sums(spark.createDataFrame(asked, "qid long, term string, last boolean"), spark.createDataFrame(scores, "term string, last boolean, doc_id long, score double"), limit).collect()}
    for q in range(30):
        mine = sorted((s for (p, _), s in sums.items() if p == q), reverse=True)
        least = mine[limit - 1] if len(mine) >= limit else 0
        best = {d: s for (p, d), s in sums.items() if p == q and s >= least - 1e-9}
        assert all(got.get((q, d)) == pytest.approx(s) for d, s in best.items())
    assert all(v == pytest.approx(sums[k]) for k, v in got.items())
    assert not [k for k in got if k[0] == 99]


@pytest.mark.parametrize("allowed", [None, 2])
def test_what_is_written_does_not_grow_with_queries_times_records(spark, monkeypatch, allowed):
    """The records of a query are neither written nor shuffled; parts of scores in any order give the same best."""
    rng = random.Random(3)
    words = [f"mot{chr(97 + i)}" for i in range(20)]
    rows = [(i, "x", "", " ".join(w for w in words for _ in range(rng.randrange(4)))) for i in range(300)]
    index = L.build(spark.createDataFrame(rows, RECORDS))
    written = []
    keep = L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    texts = [(q, " ".join(rng.sample(words, 3))) for q in range(300)]
    some = spark.createDataFrame([(i,) for i in range(0, 300, allowed)], "id long") if allowed else None
    got = L.search(index, spark.createDataFrame(texts, "qid long, text string"), L.Weights(0, 0, 1.0), 7, some).collect()
    assert sum(t.count() for t in written) < 3000
    docs = {i: Counter(t.split()) for i, _, _, t in rows}
    mean, df = sum(sum(c.values()) for c in docs.values()) / 300, Counter(w for c in docs.values() for w in c)
    for q, text in texts:
        score = {i: sum(math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in text.split()) for i, c in docs.items() if not allowed or i % allowed == 0}
        best = sorted((i for i in score if score[i]), key=lambda i: (-round(score[i], 9), i))[:7]
        assert [r.doc_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == best


def test_an_index_is_counted_without_a_shuffle(spark):
    records = spark.createDataFrame([*ROWS, *[(100 + i, "a.txt", "", "mot mot autre") for i in range(40)]], RECORDS).repartition(8)
    counted = L.build(records, keep=False).postings
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Aggregate" not in plan
    assert {(r.field, r.term, r.len, r.tf) for r in counted.where("doc_id = 2").collect()} == {("name", "facture", 2, 1), ("name", "pdf", 2, 1), ("path", "docs", 1, 1), ("content", "cuisine", 3, 2), ("content", "facture", 3, 1)}


def test_vectors_of_many_queries_without_lists_of_all_tasks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q = rng.integers(-127, 128, (400, 8))
    vectors = spark.createDataFrame([(i, i // 2, False, q[i].tolist()) for i in range(400)], "row long, file_id long, is_name boolean, q array<int>")
    asked = spark.createDataFrame([(i, q[-i].tolist()) for i in range(60)], "qid long, q array<int>")
    rows = lambda: sorted((r.qid, r.row, r.file_id, round(r.cos, 9)) for r in S.top_rows(vectors, asked, 9).collect())
    listed = rows()
    monkeypatch.setattr(S, "LISTED", 0)
    assert rows() == listed and len(listed) == 540
    plan = S.top_rows(vectors, asked, 9)._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString() and plan.toRdd().getNumPartitions() > 1


def test_use_of_hits_and_words_of_queries_without_a_shuffle(spark):
    now = 1e9
    clicks = spark.createDataFrame([(1, now - 86400, "facture edf", 7), (2, now - 90000, "facture", 7), (3, now - 86400, "autre", 8)], "id long, at double, query string, file_id long")
    clicks = clicks.select("id", F.timestamp_seconds("at").alias("ts"), "query", "file_id")
    asked = spark.createDataFrame([(1, "factu"), (2, "autre"), (3, "")], "qid long, text string")
    hits = spark.createDataFrame([(q, i, 1.0, 0, None) for q in (1, 2, 3) for i in (7, 8, 9)], "qid long, id long, score double, lex_rank int, sem_rank int")
    got = logs.with_use(hits, clicks, asked, now)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(r.qid, r.id): (r.general, r.specific) for r in logs.use(clicks, asked, hits, now).collect()}
    assert {(r.qid, r.id): (r.general, r.specific) for r in got.collect()} == want and len(want) == 9


def test_a_filter_after_the_limit_leaves_gaps(spark, index, monkeypatch):
    written, keep = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: written.append(name) or keep(df, name))
    asked, some = spark.createDataFrame([(1, "cuisine "), (2, "cuisine ")], "qid long, text string"), spark.createDataFrame([(1,)], "id long")
    got = L.search(index, asked, L.Weights(0, 0, 1.0), 2, some, post_filter=True).collect()
    assert sorted((r.qid, r.doc_id, r["rank"]) for r in got) == [(1, 1, 1), (2, 1, 1)]
    assert "brought" not in written
