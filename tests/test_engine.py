import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recall_engine import registry
from recall_engine.engine import Engine
from recall_engine.operators import catalog as C, evaluate as E, fusion as R, models as M, present as P, semantic as S
from recall_engine.queries import NOW


@pytest.fixture(scope="module")
def engine(spark, tiny):
    embed = lambda q: M.embed(q.select("qid", "text"), "text", M.HashedEmbedder()).select("qid", F.col("embedding").alias("q"))
    return Engine(spark, tiny, embed=embed)


def test_search(spark, engine):
    asked = spark.createDataFrame([(1, "facture 2023"), (2, "pdf"), (3, "le devis pdf de la semaine dernière"), (4, "")], "qid long, query string")
    rows = engine.search(asked, R.Options(limit=5), NOW).collect()
    by = {q: sorted((r.place, r.id) for r in rows if r.qid == q) for q in (1, 2, 3, 4)}
    assert all(len(v) == len({i for _, i in v}) for v in by.values())
    assert [p for p, _ in by[2]] == list(range(len(by[2])))
    pdf = {r.id for r in engine.files.where("ext = 'pdf'").collect()}
    assert {i for _, i in by[2]} <= pdf
    strict = engine.search(asked.where("qid = 3"), R.Options(parsed_strict=True, limit=5), NOW).collect()
    assert all(r.relaxed or r.id in pdf for r in strict)
    only = engine.search(asked.where("qid = 1"), R.Options(split_lexical=True, limit=5), NOW, exts=["txt"]).collect()
    assert {r.id for r in only} <= {r.id for r in engine.files.where("ext = 'txt'").collect()}


def test_rerank_in_two_phases(spark, tiny):
    engine = Engine(spark, tiny, pairs=lambda: lambda pairs: [-len(p) / 100 for _, p in pairs])
    asked = spark.createDataFrame([(1, "facture"), (2, "pdf"), (3, "devis maison")], "qid long, query string")
    o = R.Options(rerank=True, rerank_top=5, rerank_weight=1e6, limit=8)
    answer = engine.answer(asked, o, NOW)
    fast, final = ({(r.qid, r.place): r.id for r in df.collect()} for df in (answer.fast, answer.final))
    assert set(fast) == set(final) and {p for _, p in fast} <= set(range(8))
    for qid in (1, 3):
        assert {fast[qid, p] for p in range(5)} == {final[qid, p] for p in range(5)}
        assert [fast[qid, p] for p in range(5, 8)] == [final[qid, p] for p in range(5, 8)]
    assert [fast[2, p] for p in range(8)] == [final[2, p] for p in range(8)]  # a query without words is not re-ranked
    passages = P.passages(answer.fast.where("qid = 1 and place < 5").select("id", "best_row"), engine.files, engine.records, engine.chunks)
    length = {r.id: len(r.passage) for r in passages.collect()}
    order = [length[final[1, p]] for p in range(5)]
    assert order == sorted(order) or len(set(order)) == 1
    assert {(r.qid, r.place): r.id for r in engine.search(asked, o, NOW).collect()} == final
    plain = Engine(spark, tiny).search(asked, o, NOW)  # no model, no second phase
    assert {(r.qid, r.place): r.id for r in plain.collect()} == fast


def test_words_are_compared_by_stems(spark):
    files = spark.createDataFrame([(1, "facture.pdf", "pdf", "R", "maisons", 0.0, 0.0, 0.0, "ok")], "id long, name string, ext string, root string, rel_parent string, mtime double, ctime double, last_used double, status string")
    hits = spark.createDataFrame([(1, 1, 1.0, 0, None)], "qid long, id long, score double, lex_rank int, sem_rank int")
    none = {"exts": F.array().cast("array<string>"), "date_from": F.lit(None).cast("double"), "date_to": F.lit(None).cast("double"), "year_hint": F.lit(None).cast("int"), "name_terms": F.lit(""), "recent": F.lit(False)}
    asked = spark.createDataFrame([(1, "factures maison")], "qid long, text string").withColumns(none)
    o = R.Options(recency=0.0)
    plain, stemmed = (R.signals(hits, files, asked, NOW, o, stem=s).first().bonus for s in (False, True))
    assert stemmed == pytest.approx(plain + o.cover)
    used = hits.withColumns({"general": F.lit(0.0), "specific": F.lit(0.0)})
    assert P.explain(used, files, asked).first().reasons == ["content"] and P.explain(used, files, asked, stem=True).first().reasons == ["name", "folder"]
    records = spark.createDataFrame([(1, "la facture du syndic")], "id long, content string")
    chunks = spark.createDataFrame([], "row long, start int, end int")
    snippet = P.snippets(hits.withColumn("best_row", F.lit(None).cast("long")), records, files, chunks, asked, stem=True).first().snippet
    assert [snippet.text[r.start : r.end] for r in snippet.ranges] == ["facture"]


def test_presets():
    assert [len(E.preset(n)) for n in ("phases", "weights", "rerank")] == [6, 21, 7]
    assert E.preset("weights")[6][1].rrf_k == 60.0 and E.preset("rerank")[1][1].rerank_top == 20


def test_evaluate(spark, engine):
    files = engine.files.select("name", "path").limit(3).collect()
    asked = spark.createDataFrame([(i, f.name, [f.path]) for i, f in enumerate(files)] + [(9, "x", ["/nowhere"])], "qid long, query string, expected array<string>")
    rows = engine.evaluate(asked, [("default", R.Options()), ("keywords", R.Options(semantic=False, parse=False))], NOW)
    assert [r["n"] for r in rows] == [3, 3] and all(r["r10"] == 1 for r in rows)
    assert [r["skipped"] for r in rows] == [1, 1] and rows[0]["p50"] is None
    wrong = spark.createDataFrame([(5, files[0].name, [files[1].path])], "qid long, query string, expected array<string>")
    row = engine.evaluate(wrong, [("default", R.Options(limit=10))], NOW, timed=1)[0]
    assert row["p50"] > 0 and row["p95"] >= row["p50"]
    if row["r3"] == 0:
        assert row["misses"][0]["expected"] == files[1].path and len(row["misses"][0]["got"]) == 3


def test_excerpt():
    text, ranges = P.excerpt("mot " * 100 + "Réunion du syndic " + "fin " * 100, ["reunion"])
    assert text.startswith("… ") and text.endswith(" …") and [text[a:b] for a, b in ranges] == ["Réunion"]
    assert P.excerpt("", ["x"]) == ("", []) and P.excerpt("court", [])[0] == "court"
    assert list(P.matches("a à", ["a"])) == [] and [*P.matches("note_été Étés d'été", ["ete"])] == [(5, 8), (9, 13), (16, 19)]
    assert P.highlights is not None and [*P.matches("les factures", ["factur"])] == [(4, 12)]


def test_passages_and_vectors(spark, tiny):
    files, records = spark.read.parquet(f"{tiny}/files.parquet"), spark.read.parquet(f"{tiny}/lexical_index.parquet")
    spans = registry.queries()["sentence_chunks"](spark, tiny)
    rows = M.passages(files, records, spans)
    vectors, chunks = M.append_vectors(M.embed(rows, "passage", M.HashedEmbedder()), 1000)
    n = rows.count()
    assert vectors.agg(F.min("row"), F.max("row"), F.count("*")).first() == (1000, 1000 + n - 1, n) and chunks.count() == n
    assert chunks.where("start = 0 and end = 0").count() == files.count()


def test_models_of_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, "a", "a b"), (1, 3, "a", None)], "qid long, id long, text string, passage string")
    load = lambda: lambda both: [float(len(p)) for _, p in both]
    assert {r.id: r.logit for r in M.score_pairs(pairs, load).collect()} == {2: 3.0, 3: 0.0}


def test_progress_and_pooling(spark):
    percent, left = C.progress(25.0, 100.0, 20.0, 10.0)
    early = C.progress(25.0, 100.0, 20.0, 1.0)[1]
    assert tuple(spark.range(1).select(percent, left, early).first()) == (25.0, 37.5, None)
    rows = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "s array<array<double>>, m array<int>")
    got = [r[0] for r in rows.select(S.mean_pool(F.col("s"), F.col("m"))).collect()]
    assert [round(x, 4) for x in got[0]] == [0.6, 0.8] and got[1] is None


def test_every_query_runs(spark, tiny):
    for name, run in registry.queries().items():
        df = run(spark, tiny)
        assert df.columns and df.count() >= 0, name


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "place", "id", "score", "lex_rank", "sem_rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
