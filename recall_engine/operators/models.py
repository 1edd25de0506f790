"""Models as parts that can be plugged in: text to vectors, and pairs to scores.

No model comes with this repository. HashedEmbedder turns words into a vector by hashing, so that everything around a
model can be run and tested; it knows no meaning.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recall_engine.functions.text import context_label, passage
from recall_engine.operators.semantic import quantise

#: Loads a model in a worker and returns a function from texts to one vector each.
Loader = Callable[[], Callable[[list[str]], np.ndarray]]


class HashedEmbedder:
    """A stand-in: words add plus or minus one at a hashed place; vectors have length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % self.dim] += 1.0 if h >> 16 & 1 else -1.0
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return run


@dataclass(frozen=True)
class Model:
    """What a model expects: the words before queries and passages, the most tokens it reads, and its vectors' length."""

    dim: int
    max_tokens: int
    query_prefix: str = ""
    passage_prefix: str = ""


# The models that vectors and scores are made with.
MODELS = {
    "e5-small": Model(384, 320, "query: ", "passage: "),
    "e5-base": Model(768, 320, "query: ", "passage: "),
    "mmarco-minilm": Model(1, 256),
}
# Ids of the marks of the vocabulary the models share; pieces of the file are counted from one further on.
BOS, PAD, EOS, UNKNOWN, SHIFT = 0, 1, 2, 3, 1


class Subwords:
    """Ids of texts and pairs for the models, from the file of a sentencepiece vocabulary.

    A text has most ids at its marks included. Of a pair the query has half of them at most, the passage the rest.
    """

    def __init__(self, path: str, most: int):
        import sentencepiece

        self.most, self.pieces = most, sentencepiece.SentencePieceProcessor(model_file=path)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids without marks and without a limit."""
        found = (np.array(x, np.int64) for x in self.pieces.encode(texts))
        return [np.where(x == 0, UNKNOWN, x + SHIFT) for x in found]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.concatenate([[BOS], x[: self.most - 2], [EOS]]) for x in self.plain(texts)]

    def pairs(self, pairs: list[tuple[str, str]]) -> list[np.ndarray]:
        queries, passages = self.plain([a for a, _ in pairs]), self.plain([b for _, b in pairs])
        heads = [q[: self.most // 2] for q in queries]
        return [np.concatenate([[BOS], q, [EOS, EOS], p[: max(1, self.most - len(q) - 4)], [EOS]]) for q, p in zip(heads, passages, strict=True)]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in one matrix, and where they are ids."""
    size = np.array([len(x) for x in rows])
    mask = np.arange(size.max(initial=0)) < size[:, None]
    ids = np.full(mask.shape, PAD, np.int64)
    ids[mask] = np.concatenate(rows) if len(rows) else ids[mask]
    return ids, mask.astype(np.int64)


#: From ids and mask to the first output of a network.
Network = Callable[[np.ndarray, np.ndarray], np.ndarray]


def network(path: str, threads: int = 2) -> Network:
    """A network in the ONNX format; the runtime is optional."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads, options.enable_cpu_mem_arena = threads, False
    session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    wants = {i.name for i in session.get_inputs()}
    return lambda ids, mask: session.run(None, {k: v for k, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", np.zeros_like(ids))) if k in wants})[0]


@dataclass(frozen=True)
class TextModel:
    """A loader of a model of texts for embed(): mean of the states of the tokens, scaled to length one."""

    key: str
    vocabulary: str
    open: Callable[[], Network]
    asks: bool = field(default=False)

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        model, run = MODELS[self.key], self.open()
        cut = Subwords(self.vocabulary, model.max_tokens)
        prefix = model.query_prefix if self.asks else model.passage_prefix

        def vectors(texts: list[str]) -> np.ndarray:
            ids, mask = padded(cut.texts([prefix + t for t in texts]))
            total = np.einsum("btd,bt->bd", run(ids, mask), mask.astype(np.float32))
            mean = total / np.maximum(mask.sum(1, keepdims=True), 1e-9)
            return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)

        return vectors


@dataclass(frozen=True)
class PairModel:
    """A loader of a model of pairs for score_pairs(): the first output of each pair."""

    key: str
    vocabulary: str
    open: Callable[[], Network]

    def __call__(self) -> Callable[[list[tuple[str, str]]], np.ndarray]:
        run, cut = self.open(), Subwords(self.vocabulary, MODELS[self.key].max_tokens)

        def scores(pairs: list[tuple[str, str]]) -> np.ndarray:
            return run(*padded(cut.pairs(pairs))).reshape(len(pairs), -1)[:, 0] if pairs else np.zeros(0, np.float32)

        return scores


def embed(rows: DataFrame, column: str, load: Loader, batch: int = 64, prefix: str = "") -> DataFrame:
    """Rows with embedding (array<float>) of a text column; a null text has none.

    A worker loads the model once; texts of a batch go to it sorted by length, so that little is padded.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            texts = b.column(names.index(column)).to_pylist()
            order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts[i]))
            out: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                for i, v in zip(part, model([prefix + texts[i] for i in part]), strict=True):
                    out[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>"
    return rows.mapInArrow(run, schema)


def passages(files: DataFrame, records: DataFrame, spans: DataFrame) -> DataFrame:
    """file_id, is_name, start, end, passage: the label of every file, and every chunk with its label before it."""
    f = files.select(F.col("id").alias("file_id"), "name", "root", "rel_parent")
    folder = F.when(F.col("rel_parent") == "", F.col("root")).otherwise(F.concat_ws("/", "root", "rel_parent"))
    names = f.select("file_id", F.lit(True).alias("is_name"), F.lit(0).alias("start"), F.lit(0).alias("end"), context_label("name", folder).alias("passage"))
    body = F.expr("substring(content, start + 1, end - start)")
    chunks = spans.select(F.col("id").alias("file_id"), "start", "end").join(f, "file_id").join(records.select(F.col("id").alias("file_id"), "content"), "file_id")
    return names.unionByName(chunks.select("file_id", F.lit(False).alias("is_name"), "start", "end", passage("name", "rel_parent", body).alias("passage")))


def append_vectors(embedded: DataFrame, first_row: int) -> tuple[DataFrame, DataFrame]:
    """New vectors(row, file_id, is_name, q, scale) and chunks(row, file_id, start, end), numbered from first_row."""
    from recall_engine.operators.catalog import numbered_rows

    rows = numbered_rows(embedded.where("embedding is not null"), ["file_id", "start", "end"]).withColumn("row", F.col("number") - 1 + first_row)
    q, scale = quantise(F.col("embedding"))
    return rows.select("row", "file_id", "is_name", q.alias("q"), scale.alias("scale")), rows.select("row", "file_id", "start", "end")


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch: int = 32) -> DataFrame:
    """qid, id, logit of pairs(qid, id, text, passage) by a model of pairs; it is loaded once by each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            both = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            out = [float(x) for at in range(0, len(both), batch) for x in model([(a or "", p or "") for a, p in both[at : at + batch]])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["qid", "id", "logit"])

    return pairs.select(F.col("qid").cast("long"), F.col("id").cast("long"), "text", "passage").mapInArrow(run, "qid long, id long, logit double")
