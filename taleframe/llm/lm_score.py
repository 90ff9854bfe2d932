"""Language-model scoring: hashed-context bit predictors under gated logistic mixing.

A text is scored as one stream of binary decisions, word after word in its order (see mixing_model).  Everything that is
counted is counted over all training texts: words; zeros and ones at the nodes of ranks, in all and by class, from those
counts; zeros and ones after the last word and the last two, in hashed tables of one size; and zeros and ones of the bytes
of distinct words, from which words without a rank are spelled.  Mixing weights are learned online over the training
words of each partition, each word left out of its own counts, and averaged; refinement tables are counted on the way.

The class of a text is not given but guessed from the words before, so it changes while a text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.llm.common import fold, read, stage
from taleframe.llm.mixing_model import CONTEXTS, HEAD, NEAR, NEAR_SLOTS, SLOTS, START, Mixer, WordMixer, add_near, add_slots, node_counts, word_events

#: Classes of documents that get counts of their own, at most (the commonest labels); rarer ones share one more.
CLASSES = 7
#: Bytes of a word with a rank, at most; longer ones are spelled.
HEAD_BYTES = 256
RATE, STEP = 0.06, 32768
#: Words that are encoded at once.
BATCH_WORDS = 1 << 17
#: Bytes of text that are split at once, and of spelled words that are turned into events at once.
PIECE, SPELLED = 1 << 23, 1 << 20
#: Counts that a task holds before it puts equal ones together, by rows and by bytes.
_HELD, _HELD_BYTES = 800_000, 1 << 26
_BLOCK, _FAN = 1 << 17, 64
_CLASS_SHIFT = 24


@dataclass
class Piece:
    """Texts that are split at once: their distinct words, the words of all in order (each text's end, the empty word, last), and how many a text has."""

    at: int
    distinct: pa.Array
    word: np.ndarray
    sizes: np.ndarray


def _split(texts: pa.Array, at: int) -> Piece:
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # a blank at the end makes an empty word there; a text without words is one already
    closed = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), trimmed, pc.binary_join_element_wise(trimmed, " ", ""))
    del trimmed
    parts = pc.ascii_split_whitespace(closed)
    del closed
    words = parts.flatten().dictionary_encode()
    return Piece(at, words.dictionary, words.indices.to_numpy(), pc.list_value_length(parts).to_numpy().astype(np.int64))


def split_words(texts: pa.Array) -> Iterator[Piece]:
    """Words of texts (A-Z lower-cased, apart by ASCII white space; null: none), about PIECE bytes of text at a time."""
    read = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(read, read[at] + PIECE, side="right")) - 1)
        yield _split(texts.slice(at, end - at), at)
        at = end


def _merged(held: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(held).group_by(["token", "cls"], use_threads=False).aggregate([("n", "sum")])
    return both.select(["token", "cls", "n_sum"]).rename_columns(["token", "cls", "n"]).combine_chunks()


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """token, c (training count), c_0... (by class) of every word of ``docs`` and of the end, the empty token.

    ``docs`` has text, cls (class number) and train; words of other documents come with count 0.
    """
    names = ["token", "cls", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            own, train = b.column("cls").to_numpy().astype(np.int64), b.column("train").to_numpy(zero_copy_only=False)
            for p in split_words(b.column("text")):
                texts = slice(p.at, p.at + len(p.sizes))
                key = p.word + np.repeat(own[texts] * len(p.distinct), p.sizes)
                size = classes * len(p.distinct)
                n, at = np.bincount(key[np.repeat(train[texts], p.sizes)], minlength=size), np.flatnonzero(np.bincount(key, minlength=size))
                cls, word = np.divmod(at, len(p.distinct))
                held.append(pa.table([p.distinct.take(pa.array(word)), pa.array(cls.astype(np.int32)), pa.array(n[at])], names))
                if sum(map(len, held)) > _HELD or sum(t.nbytes for t in held) > _HELD_BYTES:
                    held = [_merged(held)]
                    if len(held[0]) > _HELD // 2 or held[0].nbytes > _HELD_BYTES // 2:
                        yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _merged(held).to_batches(1 << 16)

    parts = docs.select("text", "cls", "train").mapInArrow(count, "token string, cls int, n long")
    by_class = [F.sum(F.when(F.col("cls") == k, F.col("n")).otherwise(0)).alias(f"c_{k}") for k in range(classes)]
    return parts.groupBy("token").agg(F.sum("n").alias("c"), *by_class)


# --- tables of one size, counted by all tasks -----------------------------------------------------------


def _zipped(part: np.ndarray) -> bytes:
    """Pairs of counts, their bytes apart by place, as most are small and differ in few of them."""
    return pa.compress(np.ascontiguousarray(part.astype("<f4").reshape(-1).view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> np.ndarray:
    places = np.frombuffer(pa.decompress(data, decompressed_size=8 * _BLOCK, codec="zstd"), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(places.T).reshape(-1).view("<f4")


def _summed(parts: DataFrame, tables: int, slots: int) -> np.ndarray:
    """The sum of what tasks have counted (which, block, task, data): ``tables`` tables of ``slots`` pairs.

    Sums are made in groups of about _FAN tasks first, and batch by batch, so no task holds what grows with the input.
    """

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * _BLOCK)
        for b in batches:
            for data in b.column("data"):
                out += _unzipped(data.as_py())
        data = _zipped(out)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), pa.array([data])], ["which", "block", "task", "data"])

    schema = "which int, block int, task int, data binary"
    once = parts.withColumn("task", F.floor(F.col("task") / _FAN).cast("int")).groupBy("which", "block", "task").applyInArrow(total, schema)
    twice = once.withColumn("task", F.lit(0)).groupBy("which", "block", "task").applyInArrow(total, schema)
    out = np.zeros((tables, slots, 2), dtype=np.float32)
    for r in twice.toLocalIterator():  # tables x slots / _BLOCK rows, whatever the input
        out[r["which"], r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = _unzipped(r["data"]).reshape(-1, 2)
    return out


def _blocks(tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for which in range(len(tables)):
        for block in range(tables.shape[1] // _BLOCK):
            part = tables[which, block * _BLOCK : (block + 1) * _BLOCK]
            if part.any():
                data = _zipped(part)
                yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([data])], ["which", "block", "task", "data"])


def _averaged(found: DataFrame, sizes: tuple[int, ...]) -> list[np.ndarray] | None:
    """Weights averaged by how much each task has seen, and sums of the cells; a few thousand numbers, added on the executors."""
    rows = found.select("seen", F.posexplode("data").alias("at", "x")).groupBy("at")
    got = rows.agg(F.sum("x").alias("total"), (F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("mean")).collect()
    if not got:
        return None
    both = np.zeros((2, sum(sizes)))
    for r in got:
        both[:, r["at"]] = r["mean"], r["total"]
    edges = np.cumsum([0, *sizes])
    return [both[int(k == len(sizes) - 1), a:z] for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]


def _learned(start, found: DataFrame):
    got = _averaged(found, (start.weights.size, start.squares.size, start.cells.size))
    if got is None:
        return start
    return type(start)(got[0].reshape(start.weights.shape), got[1].reshape(start.squares.shape), start.cells + got[2].reshape(start.cells.shape))


def _state(model, start, seen: int) -> pa.RecordBatch:
    data = np.concatenate([model.weights.ravel(), model.squares.ravel(), (model.cells - start.cells).ravel()])
    return pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([data], pa.list_(pa.float64()))], ["seen", "data"])


# --- spelling -------------------------------------------------------------------------------------------


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of words put together, to ``rows`` or SPELLED bytes, so that events which many words share are seen once for all."""
    held, n, size = [], 0, 0
    for b in batches:
        for part in (b.slice(a, rows) for a in range(0, len(b), rows)):
            more = pc.sum(pc.binary_length(part.column("token"))).as_py() or 0
            if held and (n + len(part) > rows or size + more > SPELLED):
                yield pa.concat_batches(held)
                held, n, size = [], 0, 0
            held, n, size = [*held, part], n + len(part), size + more
    if held:
        yield pa.concat_batches(held)


def _spelled_pieces(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for part in _gathered(batches):
        counts = np.stack([part.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1) > 0
        yield part.column("token").cast(pa.binary()).to_pylist(), counts.astype(np.uint8)


def fit_spelling(vocabulary: DataFrame, classes: int) -> tuple[Broadcast, Mixer]:
    """Bytes of distinct training words, each once per class that has it, and the mixer over them."""
    names = [f"c_{k}" for k in range(classes)]
    known = vocabulary.where("c > 0").select("token", *names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((len(CONTEXTS), SLOTS, 2), dtype=np.float32)
        for words, counts in _spelled_pieces(batches, names):
            event, starts = word_events(words)
            add_slots(tables, event, np.repeat(counts, np.diff(np.r_[starts, len(event)]), axis=0))
        yield from _blocks(tables)

    tables = _summed(known.mapInArrow(count, "which int, block int, task int, data binary"), len(CONTEXTS), SLOTS)
    shared, start = vocabulary.sparkSession.sparkContext.broadcast(tables), Mixer()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, guesses = Mixer(start.weights.copy(), start.squares.copy(), start.cells.copy()), 0, None
        for words, counts in _spelled_pieces(batches, names):
            guesses = guesses or model.left_out(shared.value)
            event, starts = word_events(words)
            at, cls = np.nonzero(np.repeat(counts, np.diff(np.r_[starts, len(event)]), axis=0))
            for a in range(0, len(at), STEP):
                model.learn_from(guesses, event[at[a : a + STEP]], cls[a : a + STEP], RATE)
            seen += len(at)
        if seen:
            yield _state(model, start, seen)

    return shared, _learned(start, known.mapInArrow(learn, "seen long, data array<double>"))


def spell_words(words: DataFrame, tables, model: Mixer, classes: int) -> DataFrame:
    """``words`` (token, ...) with s_0...: bits of each word's bytes, by class."""
    names = words.columns

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = None
        for part in _gathered(batches):
            guesses = guesses or model.packed(tables.value)
            event, starts = word_events(part.column("token").cast(pa.binary()).to_pylist())
            unique, at = np.unique(event, return_inverse=True)
            cost = np.concatenate([model.bits_from(guesses, unique[i : i + 65536], classes) for i in range(0, len(unique), 65536)])
            total = np.stack([np.add.reduceat(cost[:, k].take(at), starts) for k in range(classes)])
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, total)], [*names, *(f"s_{k}" for k in range(classes))])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + "".join(f", s_{k} double" for k in range(classes))
    return words.mapInArrow(spell, schema)


# --- ranks and contexts ---------------------------------------------------------------------------------


def _least(words: DataFrame) -> int:
    """The least count at which at most HEAD short words have it, from a histogram of counts by their size."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    rows = words.where((F.col("c") > 0) & (F.octet_length("token") <= HEAD_BYTES)).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    kept, least = 0, 1 << 62
    for r in sorted(rows.collect(), key=lambda r: -r["level"]):
        kept += r["n"]
        if kept > HEAD:
            break
        least = r["least"]
    return least


@dataclass
class Ranks:
    """Frequent words by rank (0: all others): base score, what each class makes of a word, and what a class starts with."""

    words: list[bytes]
    base: np.ndarray
    leaning: np.ndarray
    prior: np.ndarray


def _leading(leaning: np.ndarray, prior: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The class that the words before each word speak for most; ``leaning`` has a row per class."""
    for k, per_rank in enumerate(leaning):
        lean = per_rank.take(rank)
        total = np.cumsum(lean, dtype=np.float64)
        total -= lean
        total -= np.repeat(total[starts] - prior[k], sizes)
        if k == 0:
            most, cls = total, np.zeros(len(rank), dtype=np.int64)
        else:
            np.copyto(cls, k, where=total > most)
            np.maximum(most, total, out=most)
    return cls


def encode_documents(marked: DataFrame, ranks, kind: str) -> DataFrame:
    """Rows of texts (rid, doc_id, train, cls, n_tokens, n_bytes, n_known, base, codes) and of their spelled words (rid, token, klass, tf).

    A code is a word's rank and the class guessed from the words before it.
    """
    names = ["rid", "doc_id", "train", "cls", "n_tokens", "n_bytes", "n_known", "base", "codes", "token", "klass", "tf"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Ranks = ranks.value
        ranked, leaning = pa.array(held.words, pa.binary()), np.ascontiguousarray(held.leaning.T)
        rid, none = TaskContext.get().partitionId() << 33, pa.nulls
        for whole in batches:
            for p in split_words(whole.column("text")):
                rank_of = pc.fill_null(pc.index_in(p.distinct.cast(pa.binary()), value_set=ranked), -1).to_numpy() + 1
                size_of = pc.binary_length(p.distinct).to_numpy() + 1
                ends, first = np.cumsum(p.sizes), 0
                while first < len(p.sizes):
                    before = ends[first] - p.sizes[first]
                    last = max(first + 1, int(np.searchsorted(ends, before + BATCH_WORDS)))
                    b, sizes, word = whole.slice(p.at + first, last - first), p.sizes[first:last], p.word[before : ends[last - 1]]
                    starts, rank = ends[first:last] - sizes - before, rank_of[word]
                    cls = _leading(leaning, held.prior, rank, starts, sizes)
                    codes = (rank | cls << _CLASS_SHIFT).astype("<u4")
                    blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[starts, len(codes)].astype(np.int32) * 4), pa.py_buffer(codes)])
                    known, base, n_bytes = (np.add.reduceat(x, starts) for x in ((rank > 0).astype(np.int64), held.base[rank], size_of[word].astype(np.int64)))
                    number, k = np.arange(rid, rid + len(sizes)), len(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number), b.column("doc_id"), b.column("train"), b.column("cls"), pa.array(sizes), pa.array(n_bytes), pa.array(known), pa.array(base), blobs,
                         none(k, pa.string()), none(k, pa.int32()), none(k, pa.int64())], names)
                    rare = np.flatnonzero(rank == 0)
                    of = np.searchsorted(starts, rare, side="right") - 1
                    seen, tf = np.unique((of * len(leaning) + cls[rare]) * len(p.distinct) + word[rare], return_counts=True)
                    if len(seen):
                        (at, token), k = np.divmod(seen, len(p.distinct)), len(seen)
                        of, klass = np.divmod(at, len(leaning))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number[of]), none(k, b.column("doc_id").type), none(k, pa.bool_()), none(k, pa.int32()), *(none(k, pa.int64()) for _ in range(3)), none(k, pa.float64()), none(k, pa.binary()),
                             p.distinct.take(pa.array(token)), pa.array(klass.astype(np.int32)), pa.array(tf.astype(np.int64))], names)
                    rid, first = rid + len(sizes), last

    schema = f"rid long, doc_id {kind}, train boolean, cls int, n_tokens long, n_bytes long, n_known long, base double, codes binary, token string, klass int, tf long"
    return marked.select("doc_id", "text", "train", "cls").mapInArrow(encode, schema)


def _streams(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(first row, end row, where texts start, (rank, last word, the one before, class)) of rows with codes, some words at a time."""
    codes, at = b.column("codes"), 0
    while at < len(b):
        first, held, size = at, [], 0
        while at < len(b) and size < BATCH_WORDS:
            held.append(np.frombuffer(codes[at].as_py(), dtype="<u4"))
            size, at = size + len(held[-1]), at + 1
        starts = np.cumsum([0, *(len(h) for h in held[:-1])])
        flat = np.concatenate(held)
        rank = (flat & ((1 << _CLASS_SHIFT) - 1)).astype(np.int32)
        one = np.r_[np.int32(START), rank[:-1]]
        one[starts] = START
        two = np.r_[np.int32(START), one[:-1]]
        two[starts] = START
        yield first, at, starts, (rank, one, two, (flat >> _CLASS_SHIFT).astype(np.int32))


def fit_words(coded: DataFrame, common: np.ndarray, by_class: np.ndarray) -> tuple[Broadcast, WordMixer]:
    """The tables (given ones, and zeros and ones after the last words), and the mixer over ranks."""
    training = coded.where("train").select("codes", "cls")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((NEAR, NEAR_SLOTS, 2), dtype=np.float32)
        for b in batches:
            for _, _, _, (rank, one, two, _) in _streams(b):
                add_near(tables, rank, one, two)
        yield from _blocks(tables)

    near = _summed(training.mapInArrow(count, "which int, block int, task int, data binary"), NEAR, NEAR_SLOTS)
    shared, start = coded.sparkSession.sparkContext.broadcast((common, by_class, near)), WordMixer()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, guesses = WordMixer(start.weights.copy(), start.squares.copy(), start.cells.copy()), 0, None
        for b in batches:
            guesses = guesses or model.left_out(*shared.value)
            label = b.column("cls").to_numpy(zero_copy_only=False).astype(np.int32)
            for first, end, starts, stream in _streams(b):
                own = np.repeat(label[first:end], np.diff(np.r_[starts, len(stream[0])]))
                for a in range(0, len(own), STEP):
                    model.learn(guesses, *(x[a : a + STEP] for x in stream), own[a : a + STEP], RATE)
                seen += len(own)
        if seen:
            yield _state(model, start, seen)

    return shared, _learned(start, training.mapInArrow(learn, "seen long, data array<double>"))


def cost_words(coded: DataFrame, tables, model: WordMixer) -> DataFrame:
    """Texts of ``coded`` with bits: what the decisions on their ranks cost."""
    names = ["rid", "doc_id", "train", "n_tokens", "n_bytes", "n_known", "base"]

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = model.prepared(*tables.value)
        for b in batches:
            bits = np.zeros(len(b))
            for first, end, starts, stream in _streams(b):
                each = [model.cost(prepared, *(x[a : a + STEP] for x in stream)) for a in range(0, len(stream[0]), STEP)]
                bits[first:end] = np.add.reduceat(np.concatenate(each).astype(np.float64), starts)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(bits)], [*names, "bits"])

    texts = coded.where("token is null").select(*names, "codes")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "codes") + ", bits double"
    return texts.mapInArrow(cost, schema)


# --- the operator ---------------------------------------------------------------------------------------


@dataclass
class LanguageModel:
    """What was learned, and the staged tables that scoring reads."""

    ranks: Ranks
    tables: Broadcast
    words: WordMixer
    spelling: Broadcast
    letters: Mixer
    total: int
    distinct: int
    classes: int
    vocabulary: DataFrame
    coded: DataFrame
    least: int


def learn_model(docs: DataFrame, train: Column, group: str | None = "lang") -> LanguageModel:
    """Learn from the rows of ``docs`` where ``train`` is true; all rows are encoded on the way."""
    spark = docs.sparkSession
    label = F.col(group) if group else F.lit("all")
    marked = docs.select("doc_id", "text", label.cast("string").alias("label"), F.coalesce(train, F.lit(False)).alias("train"))
    common_labels = marked.where("train and label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(CLASSES).collect()
    classes = len(common_labels) + 1
    cls = F.lit(len(common_labels))
    for k, r in enumerate(common_labels):
        cls = F.when(F.col("label") == r["label"], k).otherwise(cls)
    marked = marked.withColumn("cls", cls)
    vocabulary = stage(count_words(marked, classes), "words")
    sums = vocabulary.agg(F.sum("c"), F.count_if(F.col("c") > 0), *[F.sum(f"c_{k}") for k in range(classes)]).first()
    total, distinct, sizes = sums[0] or 0, sums[1] or 0, np.array([x or 0 for x in sums[2:]], dtype=np.float64)
    least = _least(vocabulary)
    top = vocabulary.where((F.col("c") >= least) & (F.octet_length("token") <= HEAD_BYTES)).toArrow()  # HEAD rows at most
    tokens = [t.encode("utf-8") for t in top.column("token").to_pylist()]
    counts = np.stack([top.column(n).to_numpy() for n in ("c", *(f"c_{k}" for k in range(classes)))], axis=1).astype(np.float64).reshape(-1, classes + 1)
    order = sorted(range(len(tokens)), key=lambda i: (-counts[i, 0], tokens[i]))
    # row 0 is every word without a rank
    by_rank = np.vstack([np.r_[total, sizes] - counts.sum(axis=0), counts[order].reshape(-1, classes + 1)])
    leaning = np.log((by_rank[:, 1:] + 0.5) / (sizes + 0.5 * len(by_rank)))
    leaning[0] = 0
    leaning = leaning.astype(np.float32)
    ranks = Ranks([tokens[i] for i in order], np.log10((by_rank[:, 0] + 1) / (total + distinct + 1)), leaning, np.log((sizes + 1) / (total + classes)))
    ranks.base[0] = 0
    coded = stage(encode_documents(marked, spark.sparkContext.broadcast(ranks), docs.schema["doc_id"].dataType.simpleString()), "coded")
    common, by_class = node_counts(by_rank[:, 0]), np.stack([node_counts(by_rank[:, 1 + k]) for k in range(classes)])
    tables, words = fit_words(coded, common, by_class)
    spelling, letters = fit_spelling(vocabulary, classes)
    return LanguageModel(ranks, tables, words, spelling, letters, total, distinct, classes, vocabulary, coded, least)


def score_documents(docs: DataFrame, train: Column, group: str | None = "lang") -> DataFrame:
    """Score the whole text of every row of ``docs``, learning from the rows where ``train`` is true.

    Columns doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.  A text is its words
    (A-Z lower-cased, apart by ASCII white space) and one end; a null text is empty.  score is log10 of the
    probability that the mixed predictors give to the stream of words and the end, in their order.  Values of ``group``
    in training rows are the classes whose counts are kept apart; a scored row's own value is never looked at.  base_score
    is the add-one unigram score over training words.  With no training rows the base is 0 for all words and the
    model spells by its start weights.  Texts of any length are read whole; repeated rows are scored each; other columns are
    ignored; an empty table gives an empty result.
    """
    m = learn_model(docs, train, group)
    texts = cost_words(m.coded, m.tables, m.words)
    base = F.log10((F.col("c") + 1.0) / (m.total + m.distinct + 1.0))
    rest = m.vocabulary.where((F.col("c") < m.least) | (F.octet_length("token") > HEAD_BYTES)).select("token", (F.col("c") > 0).cast("long").alias("known"), base.alias("base"))
    spelled = spell_words(rest, m.spelling, m.letters, m.classes)
    rare = m.coded.where("token is not null").select("rid", "token", "klass", "tf")
    bits = F.element_at(F.array(*[f"s_{k}" for k in range(m.classes)]), F.col("klass") + 1)
    joined = rare.join(spelled, "token")
    tail = joined.groupBy("rid").agg(*[F.sum(F.col("tf") * x).alias(n) for n, x in (("t_known", F.col("known")), ("t_base", F.col("base")), ("t_bits", bits))])
    whole = texts.join(tail, "rid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    bits = add("bits", "t_bits")
    return whole.select(
        "doc_id", "train", "n_tokens", add("n_known", "t_known").cast("long").alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"),
        add("base", "t_base").alias("base_score"), (-bits * float(np.log10(2))).alias("score"), (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of documents, learned from the rows whose crc32(doc_id) mod 7 is not 2.

    Null and empty texts are an end alone; a null id counts as the empty string; texts of any length are scored whole; repeated
    rows are scored each; other columns are ignored; an empty table gives an empty result.
    """
    scored = score_documents(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
