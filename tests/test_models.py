import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_engine.operators import lexical as L, models as M, publish
from recall_engine.plans.versions import Versions

FILE = "/opt/tokenizers/piece_bpe_32k.model"
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@needs_file
def test_ids_of_texts_and_pairs():
    sentencepiece = pytest.importorskip("sentencepiece")
    own = sentencepiece.SentencePieceProcessor(model_file=FILE)
    ids = lambda t: [3 if x == 0 else x + 1 for x in own.encode(t)]
    cut = M.Subwords(FILE, 12)
    long = "le devis de la cuisine " * 9
    assert [x.tolist() for x in cut.texts(["bonjour", "", long])] == [[0, *ids("bonjour"), 2], [0, 2], [0, *ids(long)[:10], 2]]
    assert [x.tolist() for x in cut.pairs([("a", "b"), (long, long), ("", "")])] == [[0, *ids("a"), 2, 2, *ids("b"), 2], [0, *ids(long)[:6], 2, 2, *ids(long)[:2], 2], [0, 2, 2, 2]]
    matrix, mask = M.padded(cut.texts(["bonjour", ""]))
    assert matrix[1].tolist() == [0, 2] + [1] * (matrix.shape[1] - 2) and mask.sum(1).tolist() == [len(ids("bonjour")) + 2, 2]


@needs_file
def test_models_around_a_network(spark):
    def states(ids, mask):
        return np.stack([ids, np.ones_like(ids)], 2).astype(np.float32)

    text = M.TextModel("e5-small", FILE, lambda: states)()
    asked = M.TextModel("e5-small", FILE, lambda: states, asks=True)()
    a, b = text(["bonjour"])[0], asked(["bonjour"])[0]
    assert np.linalg.norm(a) == pytest.approx(1) and not np.allclose(a, b)
    rows = spark.createDataFrame([(1, "bonjour"), (2, None)], "id long, text string")
    got = {r.id: r.embedding for r in M.embed(rows, "text", M.TextModel("e5-small", FILE, lambda: states)).collect()}
    assert got[2] is None and got[1] == pytest.approx(a.tolist(), abs=1e-6)
    scores = M.PairModel("mmarco-minilm", FILE, lambda: lambda ids, mask: mask.sum(1, keepdims=True))()
    assert scores([("a", "b c d"), ("a", "b")])[0] > scores([("a", "b")])[0] and len(scores([])) == 0


def test_names_are_published_first_and_the_catalogue_with_its_index(spark, tiny, tmp_path, monkeypatch):
    files = spark.read.parquet(f"{tiny}/files.parquet")
    records = spark.read.parquet(f"{tiny}/lexical_index.parquet")
    folder = str(tmp_path / "p")
    seen = []

    def contents():
        now = publish.published(spark, folder)  # what readers see meanwhile
        seen.append((now.stage, now.index.postings.where("field = 'content'").count(), now.files.where("lexical_mtime is not null").count()))
        return records.where("content is not null")

    done = publish.index_names_first(spark, folder, files, records, contents, "s1")
    assert seen == [("names", 0, 0)] and done.stage == "content"
    whole = L.build(records)
    assert done.index.postings.count() == whole.postings.count() and done.index.docs == whole.docs
    assert done.files.where("lexical_mtime = mtime").count() == records.where("content is not null").join(files, "id").count()
    publish.index_names_first(spark, folder, files, records, contents, "s1")
    assert len(seen) == 1  # nothing is left to do
    with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
        m.setattr(Versions, "publish", lambda *_, **__: 1 / 0)
        publish.index_names_first(spark, folder, files, records, contents, "s2")
    assert publish.published(spark, folder).state == "s1"  # nothing half done is seen

    def fails():
        raise ValueError

    with pytest.raises(ValueError):
        publish.index_names_first(spark, folder, files, records, fails, "s3")
    assert publish.published(spark, folder).stage == "names"
    assert publish.index_names_first(spark, folder, files, records, contents, "s3").stage == "content" and seen[-1][0] == "names"
    assert done.state == "s1" and F is not None


def test_an_index_is_built_once_for_a_state(spark, tiny, tmp_path, monkeypatch):
    source = str(tmp_path / "records")
    rows = spark.read.parquet(f"{tiny}/lexical_index.parquet")
    rows.limit(20).write.parquet(source)
    first = L.cached(spark, source)
    with monkeypatch.context() as m:
        m.setattr(L, "build", lambda *_, **__: 1 / 0)
        again = L.cached(spark, source)
    assert again.docs == first.docs == 20 and again.averages() == first.averages()
    rows.limit(5).write.mode("append").parquet(source)
    assert L.cached(spark, source).docs == 25
    plan = again.postings.where("field = 'name' and term in ('facture', 'devis')")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "In(term" in plan
