import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recall_engine.llm import near_duplicates as N, neighbours as V, ranking, registry
from recall_engine.llm.bitslice import group_pairs


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 150), min_size=1, max_size=8), st.integers(0, 60), st.integers(0, 1 << 30))
def test_bit_sliced_distances(sizes, radius, seed):
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    sketches = rng.integers(0, 256, (n, 16), dtype=np.uint8)
    sketches[1::2] = sketches[: len(sketches[1::2]) * 2 : 2][: len(sketches[1::2])]
    sketches[1::2, 3] ^= 5
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    a, b = group_pairs(sketches, begins, radius)
    distance = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(-1)
    group = np.repeat(np.arange(len(sizes)), sizes)
    i, j = np.nonzero(np.triu((distance <= radius) & (group[:, None] == group[None]), 1))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(i.tolist(), j.tolist(), strict=True)) and len(a) == len(i)


def texts(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"mot{i}" for i in range(900)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    near = [t.replace(t.split()[5], "autre", 1) for t in base[:15]]
    return base + near + base[:3] + [base[0]] * 70


def brute(rows, k, similarity, least):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, t in rows if t and len(w := t.split()) >= least}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark):
    rows = list(enumerate(texts()))
    extra = [(500, None), (501, ""), (502, "court"), (503, "mot " * 50_000), (None, rows[0][1])]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows + extra + rows[:1]], "id long, content string, rep string")
    pairs, members = N.links(table, k=3, similarity=0.6, least=40)
    expected = brute(rows, 3, 0.6, 40)
    got = {tuple(r) for r in N.expand(pairs, members, full=200).collect()}
    assert got == expected
    star = {tuple(r) for r in N.expand(pairs, members, full=10).collect()}
    group = {}
    for r in N.components(members.select("id"), N.expand(pairs, members, full=10).toDF("a", "b")).collect():
        group[r.id] = r.group
    assert star <= expected and all(group[a] == group[b] for a, b in expected)
    empty = N.links(table.limit(0), k=3, similarity=0.6)
    assert empty[0].count() == empty[1].count() == 0


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8])
def test_recall_at_any_similarity(spark, similarity):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(400):  # pairs that share a beginning, so that about similarity of their words sequences are common
        base = rng.choice(words, 80)
        other = rng.choice(words, 80)
        cut = int(round(2 * similarity / (1 + similarity) * 80 + 2.5))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:cut], *other[cut:]]))]
    expected = brute(rows, 3, similarity, 1)
    pairs, members = N.links(spark.createDataFrame(rows, "id long, content string"), k=3, similarity=similarity)
    got = {tuple(r) for r in N.expand(pairs, members).collect()}
    assert got <= expected and len(expected) > 300 and len(got) >= 0.99 * len(expected)


def test_bands_of_a_similarity():
    assert N.banding(0.6) == (14, 2) and N.banding(1.0)[0] == 1
    for x in np.linspace(0.06, 0.99, 94):
        bands, rows = N.banding(x)
        assert (1 - x**rows) ** bands <= N.MISS and bands * rows <= N.BITS
    with pytest.raises(ValueError):
        N.banding(0.01)


def test_large_classes_of_different_texts_lose_nothing(spark):
    base = texts(2)[:2]
    edited = base[0].replace(base[0].split()[5], "autre", 1)
    rows = list(enumerate([base[0].upper() if i % 3 else base[0].replace(" ", ", ") for i in range(70)] + [edited.title() if i % 2 else edited for i in range(5)] + base[1:]))
    expected = {(a, b) for b in range(75) for a in range(b)}
    pairs, members = N.links(spark.createDataFrame(rows, "id long, content string"), k=3, similarity=0.6, least=40)
    for got in (N.expand(pairs, members), N.expand(pairs, members, block=9)):
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_large_classes_over_several_files_lose_nothing(spark):
    q, close, far = [100] * 8, [100] * 7 + [90], [-100, 100] * 4
    rows = [(i, i // 30, q) for i in range(75)] + [(80, 0, close), (81, 1, close), (82, 5, far)]
    table = spark.createDataFrame([(*r, False) for r in rows], "row long, file_id long, q array<tinyint>, is_name boolean")
    expected = {(a, b) for a, f, _ in rows[:-1] for b, g, _ in rows[:-1] if a < b and f != g}
    assert {tuple(r) for r in V.similar(table, dim=8).collect()} == expected


def test_classes_of_any_size_lose_nothing(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], 0
    for size in (63, 65, 1000):
        q = rng.integers(-100, 101, 16).tolist()
        files = [int(x) for x in rng.integers(0, 9, size)]
        rows += [(len(rows) + i, 100 * size + f, q) for i, f in enumerate(files)]
        alike = sum(n * (n - 1) // 2 for n in np.bincount(files).tolist())
        expected += size * (size - 1) // 2 - alike
    table = spark.createDataFrame(rows, "row long, file_id long, q array<int>").withColumn("q", F.col("q").cast("array<tinyint>"))
    file, vector = {r: f for r, f, _ in rows}, {r: v for r, _, v in rows}
    got = [tuple(r) for r in V.similar(table, dim=16).collect()]
    assert len(got) == len(set(got)) == expected
    assert all(a < b and file[a] != file[b] and vector[a] == vector[b] for a, b in got)


def test_links_through_representatives_of_two_tags(spark):
    members = spark.createDataFrame([(1, 1, 5, 7), (2, 1, 5, 7), (3, 1, 5, 8), (4, 1, 5, 8), (5, 1, 5, 9), (6, 6, 1, 7)], "id long, rep long, size long, tag long")
    got = sorted(tuple(r) for r in N.expand(spark.createDataFrame([(1, 6)], "rep_a long, rep_b long"), members, full=4).collect())
    assert got == [(1, 3), (1, 4), (1, 5), (2, 3), (3, 5), (3, 6)]


def test_hot_buckets_lose_nothing(spark):
    rows = list(enumerate(texts(1)[:58]))
    table = N.sketches(spark.createDataFrame(rows, "id long, content string"), 3, 1).select("id", "sketch", F.array(F.lit(1).cast("long")).alias("bands"))
    whole = {tuple(r) for r in N.candidates(table, 64, block=1000).collect()}
    split = {tuple(r) for r in N.candidates(table, 64, block=7).collect()}
    assert whole == split and len(whole) > 100


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 100, 101, 200]], "id long")
    got = {r.id: r.group for r in N.components(nodes, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and got[200] == 200


VECTORS = "row long, file_id long, q array<int>, scale float, rep int"


def vectors(spark, n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    q = rng.integers(-100, 101, (n, dim))
    q[1 : n // 3 : 2] = np.clip(q[: n // 3 - 1 : 2][: len(q[1 : n // 3 : 2])] + rng.integers(-15, 16, (len(q[1 : n // 3 : 2]), dim)), -127, 127)
    q[n // 3] = 0
    rows = [(i, i // 2 if i > n // 2 else i, q[i].tolist(), 1.0, 0) for i in range(n)]
    rows += [(n, -1, q[0].tolist(), 1.0, 0), (n + 1, 5, None, 1.0, 0), (n + 2, None, q[0].tolist(), 1.0, 0), (n + 3, 9999, [1, 2], 1.0, 0), (None, 1, q[0].tolist(), 1.0, 0), (0, 0, q[0].tolist(), 1.0, 0)]
    return q, rows, spark.createDataFrame(rows, VECTORS).withColumn("q", F.col("q").cast("array<tinyint>"))


def pairs_of(q, rows, cosine):
    live = [(r, f) for r, f, v, *_ in rows if r is not None and f not in (None, -1) and v and len(v) == q.shape[1] and any(v)]
    live = dict(live)
    out = set()
    for a in live:
        for b in live:
            if a < b and live[a] != live[b] and q[a] @ q[b] >= cosine * np.sqrt(float(q[a] @ q[a]) * float(q[b] @ q[b])):
                out.add((a, b))
    return out


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "LEAF", 16)
    monkeypatch.setattr(V._router, "__defaults__", (V.SAMPLE, 100))
    q, rows, table = vectors(spark)
    expected = pairs_of(q, rows, 0.9)
    assert len(expected) > 50
    assert {tuple(r) for r in V.similar(table, factor=1.0).collect()} == expected
    some = {tuple(r) for r in V.similar(table, factor=0.4).collect()}
    assert some <= expected and len(some) >= 0.9 * len(expected)
    assert V.similar(table.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [40, 100])
def test_blocks_of_large_shards_lose_nothing(spark, monkeypatch, shard):
    """The tree has one level only, so its shards are split into blocks."""
    monkeypatch.setattr(V, "LEAF", 16)
    q, rows, table = vectors(spark)
    real = V.Router.__init__
    monkeypatch.setattr(V.Router, "__init__", lambda self, sample, depth: real(self, sample, min(depth, 1)))
    expected = pairs_of(q, rows, 0.9)
    assert {tuple(r) for r in V.similar(table, factor=1.0, shard=shard).collect()} == expected
    whole = sorted(map(tuple, V.nearest(table, k=3, factor=1.0).collect()))
    assert sorted(map(tuple, V.nearest(table, k=3, factor=1.0, shard=shard).collect())) == whole


def test_nearest_among_equal_vectors(spark):
    q, far = [100] * 8, [-100, 100] * 4
    rows = [(i, 1 if i < 50 else 2 + i % 7, q) for i in range(100)] + [(200, 1, far), (220, 3, [100] * 7 + [90])]
    table = spark.createDataFrame(rows, "row long, file_id long, q array<int>").withColumn("q", F.col("q").cast("array<tinyint>"))
    got = {}
    for r in V.nearest(table, k=4, every=20, dim=8).orderBy("row_a", "rank").collect():
        got.setdefault(r.row_a, []).append(r.row_b)
    file = {r: f for r, f, _ in rows}
    for a in (0, 20, 40, 60, 80):
        assert got[a] == [r for r, f, v in rows if f != file[a] and v == q][:4]
    assert got[220] == [r for r, f, v in rows if f != 3][:4] and len(got[200]) == 4


def test_nearest_recall_over_shards(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/vectors.parquet")
    live, dim = V.live(table)
    data = live.toPandas()
    x = np.array(data.q.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in V.nearest(table, k=10, shard=150).collect():
        got.setdefault(r.row_a, set()).add(r.row_b)
    hit = total = 0
    for i in np.flatnonzero(data.row.to_numpy() % 20 == 0):
        cos = np.where(data.file_id.to_numpy() == data.file_id[i], -2, x @ x[i])
        order = np.lexsort((data.row.to_numpy(), -np.round(cos, 6)))[:10]
        hit, total = hit + len(set(data.row.to_numpy()[order]) & got[data.row[i]]), total + 10
    assert total and hit / total >= 0.95, hit / total


def test_nearest_recall(spark):
    q, rows, table = vectors(spark, 500)
    got = {}
    for r in V.nearest(table, k=3, every=20).collect():
        got.setdefault(r.row_a, []).append(r.row_b)
    x = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    file = {r: f for r, f, *_ in rows[:500]}
    hit = total = 0
    for a in range(0, 500, 20):
        order = sorted((b for b in range(500) if file[a] != file[b] and q[b].any()), key=lambda b: -x[a] @ x[b])[:3]
        hit, total = hit + len(set(order) & set(got[a])), total + 3
    assert hit / total >= 0.9 and set(got) == set(range(0, 500, 20))
    assert V.nearest(table.limit(0)).count() == 0


HITS = "search_id long, id long, score double, lex_rank int, sem_rank int, n int"


def brute_winner(hits):
    best = {}
    for s, i, score, lex, sem in hits:
        best[s, i] = (lex, sem, score)
    ahead = lambda a, b, low: a is not None and (b is None or (a < b if low else a > b))
    out = set()
    for s, i in best:
        others = [v for (t, j), v in best.items() if t == s and j != i]
        x = best[s, i]
        if others and all(ahead(x[0], y[0], True) + ahead(x[1], y[1], True) + ahead(x[2], y[2], False) >= 2 for y in others):
            out.add((s, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_winners_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda n: None if rng.random() < 0.2 else int(rng.integers(0, n))
    hits = [(s, i, None if rng.random() < 0.2 else float(rng.integers(0, 5)), pick(4), pick(4)) for s in range(60) for i in range(int(rng.integers(1, 7)))]
    hits += [(99, i, float(i), 200 - i, 200 - i) for i in range(201)]
    rows = [(*h, 0) for h in hits + hits[:20]] + [(None, 1, 1.0, 1, 1, 0), (1, None, 1.0, 1, 1, 0), (98, 1, float("nan"), 0, 0, 0), (98, 2, 5.0, 1, 1, 0)]
    table = spark.createDataFrame(rows, HITS).repartition(7)
    assert {tuple(r) for r in ranking.winners(table).collect()} == brute_winner([*hits, (98, 1, None, 0, 0), (98, 2, 5.0, 1, 1)])
    assert ranking.winners(table.limit(0)).count() == 0


def test_ranking_ignores_the_size_of_scales(spark):
    rows = [(1, i, float(10 - i), i, (i * 3) % 10, 0) for i in range(10)]
    table = spark.createDataFrame(rows, HITS)
    order = lambda t: [r.id for r in ranking.ranking(t).orderBy("position").collect()]
    assert order(table) == order(table.withColumn("score", F.col("score") * 1e6))
    got = ranking.ranking(table).collect()
    assert sorted(r.position for r in got) == list(range(1, 11)) and all(0 <= r.closeness <= 1 for r in got)
    single = spark.createDataFrame([(1, 1, None, None, None, 0), (2, 1, 1.0, 1, 1, 0), (2, 2, 1.0, 1, 1, 0)], HITS)
    assert {(r.search_id, r.id, r.position) for r in ranking.ranking(single).collect()} == {(1, 1, 1), (2, 1, 1), (2, 2, 2)}


def test_every_query_runs(spark, tiny):
    for name, run in registry.queries().items():
        df = run(spark, tiny)
        assert df.columns and df.count() >= 0, name
