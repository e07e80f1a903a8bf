"""A hidden Markov language model: trained by Baum-Welch over the partitions, scored exactly.

The model. Each word belongs to a class by a hash (the end of a text is a class of its own). A state
emits a class; a class emits a word by its count in the training texts, with an absolute discount
that leaves mass for words not seen. So states, transitions and classes are tables of a size fixed
by the parameters, and word counts, which grow with the corpus, stay in a distributed table.

The data. Texts are cut into blocks of bounded size. A block keeps its texts as numbers of its own
words, and its list of words; counts come to a block by a join over words, each at most once per
block, however often the word occurs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.llm.common import byte_words
from textward.session import staged

# Code points of the texts of a block.
BLOCK_CHARS = 1 << 25
# Tokens of a training segment; a longer text trains as several.
SEGMENT = 512
# Cells of a time by text matrix that are trained, and texts that are scored, at once.
CELLS = 1 << 17
TEXTS = 512
END = 0


@dataclass(frozen=True)
class Settings:
    states: int = 8
    classes: int = 8192  # END and hashes of words; at most 65,536
    rounds: int = 5
    stay: float = 0.9  # chance of staying in a state before training
    smoothing: float = 0.1  # added to expected counts
    seed: int = 3


@dataclass
class Model:
    start: np.ndarray  # (states,)
    moves: np.ndarray  # (states, states)
    emits: np.ndarray  # (classes, states): chance of a class in each state


def class_of(word: bytes, classes: int) -> int:
    return 1 + zlib.crc32(word) % (classes - 1)


# ---- the data -----------------------------------------------------------------------------------


def blocks(docs: DataFrame, held_out: Column, settings: Settings, id: str = "doc_id") -> DataFrame:
    """Rows of texts (block, doc_id, held_out, ids, classes) and, one per block, of words (block,
    words, counts); ids are places in the block's words, counts are those in texts not held out."""
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.drop("text").schema]).add("block", "long").add("ids", "binary").add("classes", "binary")
    schema = schema.add("words", T.ArrayType(T.BinaryType())).add("counts", T.ArrayType(T.LongType()))
    classes = settings.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chars = TaskContext.get().partitionId(), 0, 0
        places: defaultdict = defaultdict()
        places.default_factory = places.__len__
        of_class: list[int] = []
        counts = np.zeros(0, np.int64)

        def out(doc_ids, held, ids, cls, words, counted):
            n = max(len(ids), len(words))
            return pa.RecordBatch.from_arrays([
                doc_ids, held, pa.array([task << 32 | number] * n, pa.int64()),
                pa.array(ids or [None] * n, pa.binary()), pa.array(cls or [None] * n, pa.binary()),
                pa.array(words or [None] * n, pa.list_(pa.binary())), pa.array(counted or [None] * n, pa.list_(pa.int64())),
            ], names=schema.names)

        def close(like: pa.RecordBatch) -> pa.RecordBatch:
            full = np.zeros(len(places), np.int64)
            full[: len(counts)] = counts
            none = [pa.nulls(1, like.column(i).type) for i in (0, 1)]
            return out(*none, [], [], [list(places)], [full])

        batch = None
        for batch in batches:
            ids, cls, first = [], [], 0
            held = batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2).to_pylist()):
                w = byte_words(text)
                found = np.fromiter(map(places.__getitem__, w), np.uint32, len(w))
                if len(places) > len(of_class):
                    of_class += [class_of(x, classes) for x in _tail(places, len(of_class))]
                ids.append(_planes(found))
                cls.append(np.append(np.fromiter(map(of_class.__getitem__, found.tolist()), np.uint16, len(w)), np.uint16(END)).tobytes())
                if not held[i] and len(w):
                    if len(counts) < len(places):
                        counts = np.append(counts, np.zeros(len(places) + 4096 - len(counts), np.int64))
                    np.add.at(counts, found, 1)
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield out(batch.column(0)[first : i + 1], batch.column(1)[first : i + 1], ids, cls, [], [])
                    counts = counts[: len(places)]
                    yield close(batch)
                    ids, cls, first, number, chars = [], [], i + 1, number + 1, 0
                    places.clear()
                    of_class, counts = [], np.zeros(0, np.int64)
            if ids:
                yield out(batch.column(0)[first:], batch.column(1)[first:], ids, cls, [], [])
        if places:
            counts = counts[: len(places)]
            yield close(batch)

    return rows.mapInArrow(run, schema)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits as all their first bytes, then all their second ones and so on: the higher
    bytes are mostly zero and compress away wherever the rows are written."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _tail(places: dict, known: int) -> list[bytes]:
    """The words that joined a dictionary after the first ``known``, oldest first."""
    last = []
    for word in reversed(places):
        if places[word] < known:
            break
        last.append(word)
    return last[::-1]


# ---- Baum-Welch ---------------------------------------------------------------------------------


def first_model(settings: Settings, class_counts: np.ndarray) -> Model:
    """Sticky states that each emit the classes by frequency, disturbed by a seeded noise."""
    k = settings.states
    rng = np.random.default_rng(settings.seed)
    moves = np.full((k, k), (1 - settings.stay) / max(k - 1, 1))
    np.fill_diagonal(moves, settings.stay if k > 1 else 1.0)
    emits = (class_counts + settings.smoothing)[:, None] * np.exp(rng.normal(0, 0.5, (len(class_counts), k)))
    return Model(np.full(k, 1 / k), moves, emits / emits.sum(axis=0))


def _columns(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time by text matrix, texts still going on at each time) of sequences, longest first."""
    lengths = np.array([len(s) for s in sequences])
    matrix = np.zeros((lengths[0], len(sequences)), np.uint16)
    for i, s in enumerate(sequences):
        matrix[: len(s), i] = s
    return matrix, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected (starts, moves, emissions) of sequences, longest first, and their log likelihood."""
    matrix, going = _columns(sequences)
    times, texts = matrix.shape
    k = len(model.start)
    forward = np.zeros((times, texts, k))
    scale = np.ones((times, texts))
    emit = model.emits[matrix]
    now = model.start * emit[0]
    for t in range(times):
        n = going[t]
        if t:
            now = (now[:n] @ model.moves) * emit[t, :n]
        scale[t, :n] = now.sum(axis=1)
        now = now / scale[t, :n, None]
        forward[t, :n] = now
    ahead = np.zeros((times, texts, k))  # emission times backward over scale, of each time
    backward = np.ones((texts, k))
    weight = np.zeros((times, texts, k))
    for t in range(times - 1, -1, -1):
        n = going[t]
        weight[t, :n] = forward[t, :n] * backward[:n]
        ahead[t, :n] = emit[t, :n] * backward[:n] / scale[t, :n, None]
        backward[:n] = ahead[t, :n] @ model.moves.T
    moves = model.moves * (forward[:-1].reshape(-1, k).T @ ahead[1:].reshape(-1, k)) if times > 1 else np.zeros((k, k))
    flat, spread = matrix.reshape(-1), weight.reshape(-1, k)
    emits = np.stack([np.bincount(flat, spread[:, s], len(model.emits)) for s in range(k)], axis=1)
    return weight[0].sum(axis=0), moves, emits, float(np.log(scale).sum())


def train(texts: DataFrame, settings: Settings, class_counts: np.ndarray) -> Model:
    """Baum-Welch over rows with ``classes``. Tasks add up expected counts of their texts, Spark adds
    the tasks' tables by class, and the driver, which sees only tables of the model's size,
    makes the next model. A text of over SEGMENT tokens trains as consecutive segments."""
    k, spark = settings.states, texts.sparkSession
    model = first_model(settings, class_counts)
    names = [f"s{i}" for i in range(k)]
    for _ in range(settings.rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            total = [np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emits)]
            for batch in batches:
                segments = []
                for raw in batch.column(0).to_pylist():
                    s = np.frombuffer(raw, np.uint16)
                    segments += [s[i : i + SEGMENT] for i in range(0, len(s), SEGMENT)]
                segments.sort(key=len, reverse=True)
                while segments:
                    some = segments[: max(1, CELLS // len(segments[0]))]
                    segments = segments[len(some):]
                    for whole, part in zip(total, expected(model, some)):
                        whole += part
            at = np.flatnonzero(total[2].sum(axis=1))
            key = np.concatenate([at, -1 - np.arange(k), [-1 - k]])
            rows = np.concatenate([total[2][at], total[1], total[0][None]])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *map(pa.array, rows.T)], names=["key", *names])

        counted = texts.select("classes").mapInArrow(run, ", ".join(["key long", *[f"{n} double" for n in names]]))
        table = counted.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).collect()
        start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emits)
        for row in table:
            key, values = row[0], np.array(row[1:])
            if key >= 0:
                emits[key] = values
            elif key == -1 - k:
                start = values
            else:
                moves[-1 - key] = values
        start, moves, emits = (x + settings.smoothing for x in (start, moves, emits))
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
        shared.unpersist()
    return model


def log10_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the exact likelihood of each sequence, whatever its length, by scaled forward steps."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    result = np.zeros(len(sequences))
    for at in range(0, len(order), TEXTS):
        some = order[at : at + TEXTS]
        matrix, going = _columns([sequences[i] for i in some])
        total = np.zeros(len(some))
        now = np.tile(model.start, (len(some), 1))
        for t in range(len(matrix)):
            n = going[t]
            now = (now[:n] @ model.moves if t else now) * model.emits[matrix[t, :n]]
            scale = now.sum(axis=1)
            now /= scale[:, None]
            total[:n] += np.log10(scale)
        result[some] = total
    return result


# ---- scoring ------------------------------------------------------------------------------------


def score(docs: DataFrame, held_out: Column, settings: Settings | None = None, id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are the words of the text, A-Z in lower case, and one end. The model and the counts come
    from texts that are not held out. ``base_score`` is that of single words with one added to each
    count. ``score`` is the log10 probability of the text in the hidden Markov model, in which a
    word not seen has its class's discounted mass, as one event. A null text is empty and has the
    end alone; texts of any length are scored whole; repeated rows repeat and count each. A null
    ``held_out`` counts as false. Without training texts every score follows from the smoothing
    alone. An empty table gives an empty table.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    cut = staged(blocks(docs, F.coalesce(held_out, F.lit(False)), settings, id), "blocks")
    texts = cut.where("ids is not null")
    listed = cut.where("words is not null").select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    # One shuffle by word serves both the sums and the join that brings them back to the blocks.
    listed = listed.select("block", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n")).repartition("word")
    totals = listed.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("first"))
    valued = staged(
        listed.join(totals, "word").select(
            F.col("block").alias("of_block"), "at", "c", (F.crc32("word") % (settings.classes - 1) + 1).cast("int").alias("class"),
            (F.col("block") == F.col("first")).alias("once"),
        ),
        "counts",
    )
    by_class = valued.where("once and c > 0").groupBy("class").agg(
        F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))
    ).collect()  # at most one row for each class
    of_class = np.zeros((settings.classes, 4))
    for row in by_class:
        of_class[row[0]] = row[1:]
    ends = texts.where("not held_out").count()
    of_class[END] = ends, min(ends, 1), 0, 0
    tokens, kinds, once, twice = of_class.sum(axis=0)
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    model = train(texts.where("not held_out"), settings, of_class[:, 0])
    shared = spark.sparkContext.broadcast((model, of_class[:, :2]))
    base = tokens + kinds + 1

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value[0]
        for batch in batches:
            sequences = [np.frombuffer(raw, np.uint16) for raw in batch.column(4).to_pylist()]
            found = pa.array(log10_likelihoods(model, sequences), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), found], names=["doc_id", "held_out", "block", "ids", "chain"])

    kept = texts.select("doc_id", "held_out", "block", "ids", "classes")
    chained = kept.mapInArrow(forward, kept.drop("classes").schema.add("chain", "double"))
    schema = kept.select("doc_id", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        return _add_words(left, right, shared.value[1], discount, base, ends, schema.names)

    scored = chained.groupBy("block").cogroup(valued.drop("once").groupBy("of_block")).applyInArrow(add, schema)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _add_words(left, right, of_class, discount, base, ends, names) -> pa.Table:
    """Scores of a block's texts: sums of its words' values, and the chain's likelihoods."""
    at = right.column("at").to_numpy()
    n = len(at)
    c, cls = np.zeros(n), np.zeros(n, np.int64)
    c[at], cls[at] = right.column("c").to_numpy(), right.column("class").to_numpy()
    total, kinds = of_class[cls].T if n else np.zeros((2, 0))
    # What a class leaves for words not seen; all of it, if none was.
    unseen = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    within = np.where(c > 0, (c - discount) / np.maximum(total, 1), unseen)
    values = np.stack([np.ones(n), c > 0, np.log10((c + 1) / base), np.log10(within)], axis=1) if n else np.zeros((0, 4))
    end = np.array([1, ends > 0, np.log10((ends + 1) / base), 0.0])
    sums = np.empty((left.num_rows, 4))
    for i, raw in enumerate(left.column("ids").to_pylist()):
        sums[i] = values[_numbers(raw)].sum(axis=0) + end
    chain = left.column("chain").to_numpy()
    return pa.table([
        left.column("doc_id"), left.column("held_out"), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)),
        pa.array(sums[:, 2]), pa.array(sums[:, 3] + chain),
    ], names=names)
