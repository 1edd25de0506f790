"""Problem 10: pages of repeated keywords, tags or links instead of sentences.

Method: pointwise mutual information (PMI) of neighbouring words from corpus counts. One pass counts every word and every
pair of neighbours, without a floor. A second one finds the stretches of a text that stand apart from the common words of
the languages: lists of some kind, of which only some are spam. Their pairs meet the counts of the corpus: a pair is
evidence if it is bound far more than the pairs of the corpus are on average, if it is bound more and recurs in the text
(an excessively repeated collocation), or if it is bound far less (word salad). In sentences pairs of all kinds are usual,
so over all positions a pair is evidence only if it is repeated and bound to its text more than neighbours are to each
other. A text is spam if its share of listed words and its share of evidence, links included, together say that it is
mostly such a list, or if pairs of the second kind are most of its pairs, wherever they stand.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.llm.words import Words, mix, slices
from recall_engine.plans.tables import materialize, spread

#: A word is common if it is in this share of the documents. There are at most as many as 1 / COMMON times the mean number of different words of a text.
COMMON = 0.04
#: Words on each side of the window that decides whether a word stands in a list, and the least share of common words and numbers outside.
SIDE, SENTENCE = 4, 0.45
#: A number counts so much of a common word: rows of figures are no sentences, but no lists of keywords either.
NUMBER = 0.6
#: Bits above the mean PMI of the corpus from which a pair is bound far more, and below it from which it is bound far less. The deviation of PMI over pairs is about 2.8 bits in running text: half of it, and the whole.
BOUND, LOOSE = 1.4, 2.8
#: Times a pair stands in a text at least to be evidence outside lists, where names and terms come twice without being stuffed.
REPEATED = 3
#: What the share of listed words and the share of evidence sum to in a spam text: half of its words stand in lists, less
#: the edges of windows, and a part of their pairs is evidence.
SPAM = 0.65
#: Share of repeated pairs, in lists or not, above which a text is spam by them alone.
HALF = 0.5
#: Words a text has at least to be judged.
LEAST = 8
#: Entries a worker holds before it hands on its partial counts.
HELD = 1_500_000
#: Counts that are sent to every task; more are joined by a shuffle.
SMALL = 1_000_000

#: Addresses, marks of links and tags.
LINK = re.compile(r"(?:https?://|www\.)\S+|\[url=[^\]\s]*\]|</?a\b[^>]*>|#\w+")
#: Bare names of hosts: labels with dots between them, the last one of letters. Tried only where a dot stands inside a word.
HOST, _DOT = re.compile(r"[\w-]{2,}+\.(?:[\w-]++\.)*[a-z]{2,}\b(?:/\S*)?"), re.compile(r"(?<=[\w-])\.(?=[a-z])")
_NAME = re.compile(r"[\w.-]")
_TOTAL = 0  # the key of the number of words; its documents are those with a word


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Key of each pair of neighbours and the text it is in."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    if len(text) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = text[:-1] == text[1:]
    return mix(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:])[inside], text[:-1][inside]


def counts(texts: DataFrame) -> DataFrame:
    """key, n, docs of every word and every pair of neighbours (docs 0), and of key 0: all words. Workers add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            key, n, docs = merged_of(parts)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(docs)], names=["key", "n", "docs"])

        for b in batches:
            for low, high in slices(b.column(0)):
                w = Words(b.column(0).slice(low, high - low).to_pylist())
                text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                order = np.lexsort((text, w.hash))
                h, t = w.hash[order], text[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])[: len(h)]
                key, n = np.unique(_pairs(w)[0], return_counts=True)
                parts.append((h, np.ones(len(h), np.int64), new.astype(np.int64)))
                parts.append((key, n, np.zeros(len(key), np.int64)))
                parts.append((np.array([_TOTAL], np.uint64), np.array([len(h)]), np.array([len(np.unique(text))])))
                parts[-3:] = [merged_of(parts[-3:])]
                held += len(parts[-1][0])
                if held > HELD:
                    parts[:] = [merged_of(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield batch()
                        parts.clear()
                        held = 0
        if parts:
            yield batch()

    return texts.mapInArrow(run, "key long, n long, docs long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def merged_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by key of several (key, n, docs)."""
    key, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begin], np.add.reduceat(n[order], begin), np.add.reduceat(docs[order], begin)


def _near(x: np.ndarray, first: np.ndarray, side: int) -> np.ndarray:
    """Mean of x over the words up to side away, inside each text."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(x))
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    a, b = np.maximum(i - side, begin), np.minimum(i + side + 1, end)
    return (total[b] - total[a]) / np.maximum(b - a, 1)


def links_in(text: str) -> Iterator[tuple[int, int]]:
    """Places of links, tags and bare names of hosts, which no '@' stands before."""
    spans = [m.span() for m in LINK.finditer(text)]
    yield from spans
    ends, done = [end for _, end in spans], 0
    for m in _DOT.finditer(text):
        at = bisect_right(ends, m.start())
        if m.start() < done or (at < len(spans) and spans[at][0] <= m.start()):
            continue  # in a link that is found
        begin = m.start()
        while begin > done and _NAME.match(text[begin - 1]):
            begin -= 1
        if (begin == 0 or not _NAME.match(text[begin - 1]) and text[begin - 1] != "@") and (host := HOST.match(text, begin)):
            done = host.end()
            yield host.span()


def lists_of(texts: list[str], common: np.ndarray) -> dict[str, object]:
    """Of each text: words, listed and linked (shares of words), and its pairs of neighbours outside links that may be evidence.

    common: sorted hashes of the common words. pairs is (text, word, next word, pair, times in lists, times, has a number),
    one for each distinct pair of a text that stands in a list, or at least REPEATED times anywhere without a number.
    """
    w = Words(texts)
    n = np.diff(w.first)
    text = np.repeat(np.arange(len(n)), n)
    each = lambda x: np.bincount(text, x, len(n)) / np.maximum(n, 1)
    at = np.minimum(np.searchsorted(common, w.hash), max(0, len(common) - 1))
    plain = common[at] == w.hash if len(common) else np.zeros(len(w.hash), bool)
    joined = w.code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    link = np.zeros(len(w.code) + 1, np.int8)
    for begin, end in links_in(joined):
        link[begin:end] = 1
    link = link[w.starts].astype(bool)
    # words that hyphens join are parts of a name (Pont-sur-Lue): they speak neither for a sentence nor against it
    code = np.concatenate([w.code, [0]])
    joined_up = ((code[w.starts - 1] == 45) | (code[w.ends] == 45)) & ~link
    start = w.code[w.starts] if len(w.starts) else np.zeros(0, np.uint32)
    number = (start >= 48) & (start <= 57) & ~link
    alone = np.flatnonzero(~joined_up)
    bound = np.searchsorted(alone, w.first)
    near = _near(((plain & ~link) + NUMBER * number)[alone], bound, SIDE)
    # a joined word is where the word before it is, else the one after it; a longer run of them than a name is a list
    before = np.clip(np.cumsum(~joined_up) - 1, np.repeat(bound[:-1], n), np.repeat(bound[1:], n) - 1)
    some = np.repeat(np.diff(bound) > 0, n)
    edge = np.flatnonzero(np.concatenate([[True], (joined_up[1:] != joined_up[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, np.int64)
    length = np.diff(np.append(edge, len(text)))
    run = joined_up & np.repeat(length > 2 * SIDE, length)
    listed = link | run | np.where(some, np.append(near, 0.0)[np.maximum(before, 0)] < SENTENCE, True)
    key, of = _pairs(w)
    left = np.flatnonzero(text[:-1] == text[1:]) if len(text) > 1 else np.zeros(0, np.int64)
    kept = np.flatnonzero(~(link[left] & link[left + 1]))
    own = mix(key[kept] ^ mix(of[kept].astype(np.uint64) + np.uint64(1)))
    _, one, same, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    in_list = np.bincount(same, (listed[left] & listed[left + 1])[kept], len(one)).astype(np.int64)
    one = kept[one]
    # figures that recur, as in logs and tables, are no keywords
    figure = number[left[one]] | number[left[one] + 1]
    needed = np.flatnonzero((in_list > 0) | ((times >= REPEATED) & ~figure))
    order = needed[np.argsort(of[one[needed]], kind="stable")]
    in_list, times, figure, one = in_list[order], times[order], figure[order], one[order]
    return {"words": n.astype(np.int64), "listed": each(listed), "linked": each(link), "pairs": (of[one], w.hash[left[one]], w.hash[left[one] + 1], key[one], in_list, times, figure)}


_LISTED = "row long, doc_id long, words long, listed double, linked double, pairs array<struct<a:long,b:long,ab:long,in_list:int,times:int,figure:boolean>>"


def _listed(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """lists_of() every text of rows(doc_id, text) with a word, and a number of its own (row)."""
    held = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 40
        for b in batches:
            for low, high in slices(b.column(1)):
                x = lists_of(b.column(1).slice(low, high - low).to_pylist(), held.value)
                n = len(x["words"])
                of, a, c, ab, in_list, times, figure = x["pairs"]
                fields = [pa.array(v.view(np.int64)) for v in (a, c, ab)] + [pa.array(v.astype(np.int32)) for v in (in_list, times)] + [pa.array(figure)]
                inside = pa.StructArray.from_arrays(fields, names=["a", "b", "ab", "in_list", "times", "figure"])
                offsets = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
                arrays = [pa.array(next_row + np.arange(n)), b.column(0).slice(low, high - low), pa.array(x["words"]), pa.array(x["listed"]), pa.array(x["linked"]), pa.ListArray.from_arrays(offsets, inside)]
                next_row += n
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "words", "listed", "linked", "pairs"])

    return rows.mapInArrow(run, _LISTED).where("words > 0")


def corpus_mean(table: DataFrame) -> tuple[float, float, float]:
    """Words, texts with a word, and the mean PMI of all pairs of the corpus, from the table of counts."""
    log = F.col("n") * F.log2("n")
    word, pair = (F.col("docs") > 0) & (F.col("key") != _TOTAL), (F.col("docs") == 0) & (F.col("key") != _TOTAL)
    r = table.agg(
        F.sum(F.when(F.col("key") == _TOTAL, F.col("n"))), F.sum(F.when(F.col("key") == _TOTAL, F.col("docs"))), F.sum(F.when(word, log)), F.sum(F.when(pair, log)), F.sum(F.when(pair, F.col("n")))
    ).first()
    words, texts = float(r[0] or 0), float(r[1] or 0)
    # a word is the first of a pair about as often as it occurs, and the second as often
    return words, texts, float(np.log2(words) + r[3] / r[4] - 2 * r[2] / words) if r[4] else 0.0


def scores(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, words, listed, linked, evidence, list_pmi, corpus_pmi of every text with a word.

    listed and linked are shares of words. evidence is the share of neighbours that stand in lists and whose pair is
    evidence (see above), plus linked; or, if that says more, so much that listed and evidence reach SPAM where the share
    of repeated pairs in the whole text reaches HALF. list_pmi is the mean PMI of the pairs in lists, null without any;
    corpus_pmi the mean of all pairs. Null, empty
    and wordless texts have no row, repeated rows stay, a null id stays null, other columns are ignored, an empty table
    gives no rows. Counts cover all words and pairs of all texts. Two tables are written while the plan is built: the
    counts, and the pairs that stand in lists or are repeated, which are few; only these meet the counts, in the JVM, as
    no other pair can be evidence. Texts are never shuffled.
    """
    rows = spread(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("length(text) > 0"))
    table = materialize(counts(rows.select("text")), "counts")
    words, texts, mean = corpus_mean(table)
    usual = table.where((F.col("docs") >= max(1.0, COMMON * texts)) & (F.col("key") != _TOTAL)).select("key").toArrow()["key"].to_numpy()
    listed = materialize(_listed(rows, np.sort(usual.astype(np.int64).view(np.uint64))), "listed")
    pairs = listed.select("row", "doc_id", "words", "listed", "linked", F.explode_outer("pairs").alias("p")).select("row", "doc_id", "words", "listed", "linked", "p.*")
    needed = listed.select(F.explode("pairs").alias("p")).select(F.explode(F.array("p.a", "p.b", "p.ab")).alias("key")).distinct()
    known = materialize(table.join(needed, "key", "left_semi").select("key", "n"), "needed")
    small = known.count() <= SMALL
    for c in ("a", "b", "ab"):
        side = known.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"))
        pairs = pairs.join(F.broadcast(side) if small else side, c, "left")
    pmi = F.log2(F.col("n_ab") * F.lit(words) / (F.col("n_a") * F.col("n_b")))
    pairs = pairs.withColumn("pmi", pmi)
    over = F.col("pmi") - F.lit(mean)
    odd = (over > BOUND) | ((over > 0) & (F.col("times") >= 2)) | (over < -LOOSE)
    # of the pair and its text, as pmi is of a pair's two words
    own = F.log2(F.col("times") * F.lit(words) / (F.col("n_ab") * F.col("words")))
    stuffed = ~F.col("figure") & (F.col("times") >= REPEATED) & (own > mean)
    share = lambda when, times: F.sum(F.when(when, F.col(times)).otherwise(0)) / F.greatest(F.max("words") - 1, F.lit(1))
    found = pairs.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "words", "listed", "linked")], share(odd, "in_list").alias("shown"), share(stuffed, "times").alias("repeated"), (F.sum(F.col("pmi") * F.col("in_list")) / F.sum(F.when(F.col("pmi").isNotNull() & (F.col("in_list") > 0), F.col("in_list")))).alias("list_pmi"))
    evidence = F.greatest(F.col("shown") + F.col("linked"), F.col("repeated") * F.lit(SPAM / HALF) - F.col("listed"))
    return found.select("doc_id", "words", "listed", "linked", evidence.alias("evidence"), "list_pmi", F.lit(mean).alias("corpus_pmi"))


def is_spam() -> F.Column:
    """Spam by the columns of scores: both listed and shown by PMI or links to be a list of keywords, tags or links."""
    return (F.col("words") >= LEAST) & (F.col("listed") + F.col("evidence") > SPAM)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(is_spam()).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)
