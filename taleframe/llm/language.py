"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.llm.common import DOCUMENT_COLUMNS, fold, read

UNKNOWN = "und"
#: Labelled documents that training looks at, at most, dealt evenly over the languages, and characters of each.
#: Prediction reads whole texts of any length.
SAMPLE, LONGEST = 2400, 20_000
ORDERS, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 16, 16
EPOCHS, RATE, PIECES = 6, 0.5, 2
#: Of the right predictions in the calibration part, the share that the rejection threshold may refuse.
REFUSED = 0.001
BATCH_BYTES = 1 << 19
_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def _buckets(data: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """For each order, the bucket of the byte n-gram that starts at each place; ``data`` ends in padding."""
    n = len(data) - max(ORDERS) + 1
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    h = np.zeros(n, dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        h = h * _STEP + data[order - 1 : order - 1 + n] + np.uint32(1)
        if order in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * _MIX) >> shift


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array with blanks after each text, where each text starts, and the places whose n-grams may reach the next text."""
    pad = b" " * max(ORDERS)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum([0, *(sizes[:-1] + len(pad))])
    beyond = (starts + sizes + 1)[:-1, None] + np.arange(len(pad) - 1)
    return np.frombuffer(pad.join(texts) + pad, dtype=np.uint8).astype(np.uint32), starts, beyond.ravel()


@dataclass
class LanguageModel:
    """Languages, the score of each bucket for each (embedding and softmax folded), bias, temperature, threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """A row a text, whatever the texts beside it: means over the n-grams that start in it or right behind it."""
        data, starts, beyond = _padded(texts)
        table = np.vstack([self.table, np.zeros((1, len(self.languages)), self.table.dtype)])
        total = np.zeros((len(texts), len(self.languages)), dtype=np.float64)
        for idx in _buckets(data, len(self.table)):
            idx[beyond] = len(self.table)
            total += np.add.reduceat(table[idx], starts, axis=0, dtype=np.float64)
        size = np.array([len(t) + 1 for t in texts])
        return total / (size[:, None] * len(ORDERS)) + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data, _, _ = _padded([text])
    idx, n = np.unique(np.concatenate(list(_buckets(data, BUCKETS))), return_counts=True)
    return idx.astype(np.int64), (n / n.sum()).astype(np.float32)


def _pieces(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """The text and a few short stretches of it, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for _ in range(PIECES if len(words) > 3 else 0):
        n = int(rng.integers(2, 13))
        a = int(rng.integers(0, max(1, len(words) - n)))
        out.append(b" ".join(words[a : a + n]))
    return out


def fit_languages(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """Train on a list of labelled texts by stochastic gradient descent; a fifth of them calibrates."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    apart = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
    rows, targets = [], []
    for t, k, held in zip(map(_bytes, texts), y, apart, strict=True):
        if not held:
            for piece in _pieces(t, rng):
                rows.append(_sparse(piece))
                targets.append(k)
    target = np.array(targets)
    n_lang = len(languages)
    emb = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, n_lang), dtype=np.float32)
    bias = np.zeros(n_lang, dtype=np.float32)
    steps = EPOCHS * len(rows)
    done = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 8)):
            rate = RATE * (1 - done / steps)
            done += len(batch)
            idx = np.concatenate([rows[i][0] for i in batch])
            val = np.concatenate([rows[i][1] for i in batch])
            first = np.cumsum([0, *(len(rows[i][0]) for i in batch[:-1])])
            hidden = np.add.reduceat(emb[idx] * val[:, None], first, axis=0)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), target[batch]] -= 1
            back = p @ out.T
            out -= (4 * rate / len(batch)) * hidden.T @ p
            bias -= rate * 0.1 * p.mean(axis=0)
            # a bucket's step is large: its share of a text is small
            per = np.repeat(np.arange(len(batch)), np.diff(np.r_[first, len(idx)]))
            np.subtract.at(emb, idx, (8 * rate) * val[:, None] * back[per])
    model = LanguageModel(languages, (emb @ out).astype(np.float32), bias.astype(np.float64))
    calibration = [i for i in range(len(y)) if apart[i]] or list(range(len(y)))
    short = [piece for i in calibration for piece in _pieces(_bytes(texts[i]), rng)]
    truth = np.concatenate([[y[i]] * len(_pieces(_bytes(texts[i]), np.random.default_rng(0))) for i in calibration]).astype(int)
    z = model.logits(short)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]))

    model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    best = model.probabilities(short)
    right = best.argmax(axis=1) == truth
    if right.any():
        model.threshold = float(min(0.5, np.quantile(best.max(axis=1)[right], REFUSED)))
    return model


def training_sample(labelled: DataFrame, rows: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], list[str]]:
    """At most ``rows`` labelled texts, as many of each language where there are, chosen by a hash of the text.

    Of a text of more than ``longest`` characters a stretch of that length is taken, from a place that the hash chooses, or from
    the first letter on if there is none in it; so no language goes because its texts are long.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    known = known.select("lang", "text", F.xxhash64("text", "lang").alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.countDistinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return [], []
    size, quota = F.length("text"), rows / len(counts)
    place = F.pmod(F.col("h"), F.greatest(size - longest, F.lit(0)) + 1).cast("int") + 1
    part = F.substr("text", place, F.lit(longest))
    part = F.when(size <= longest, F.col("text")).when(F.rlike(part, F.lit(r"\p{L}")), part).otherwise(F.substr("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(longest)))
    shares = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, quota / n))))])
    chosen = F.pmod(F.col("h"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0))
    drawn = known.where(chosen).select("lang", part.alias("text"), "h").dropDuplicates(["h"]).orderBy("h").limit(rows).collect()
    return [r["text"] for r in drawn], [r["lang"] for r in drawn]


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Columns doc_id, lang_pred, score, rejected for every row of ``docs``, from its whole text.

    lang_pred is the likeliest learned language and score its calibrated probability.  A text that is null or
    has no letter is ``und`` with score 0 and rejected; other texts are rejected if the score is under the
    model's threshold.  A model that learned nothing answers ``und`` to all.  Repeated rows stay repeated;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("text")
            lang, score = [UNKNOWN] * len(b), np.zeros(len(b))
            todo = [i for i, ok in enumerate(b.column("letters").to_pylist()) if ok] if m.languages else []
            for part in _in_batches(texts, todo):
                p = m.probabilities([t for _, t in part])
                for (i, _), k, q in zip(part, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = m.languages[k], q
            no = (score < m.threshold) | np.array([x == UNKNOWN for x in lang], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(no)], ["doc_id", "lang_pred", "score", "rejected"])

    seen = docs.select("doc_id", "text", F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return seen.mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def train_languages(docs: DataFrame, rows: int = SAMPLE) -> LanguageModel:
    return fit_languages(*training_sample(docs.select("text", "lang"), rows))


def _in_batches(texts: pa.Array, todo: list[int]) -> Iterator[list[tuple[int, bytes]]]:
    """(row, text) of the rows ``todo``, about BATCH_BYTES at a time; a longer text is alone."""
    part: list[tuple[int, bytes]] = []
    held = 0
    for i in todo:
        part.append((i, _bytes(texts[i].as_py())))
        held += len(part[-1][1])
        if held >= BATCH_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def known_language_documents(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Documents that the model does not reject, with lang set where it was null.

    Null, empty and letterless texts go, as all do if the model learned nothing; texts of any length are read whole; repeated
    rows stay repeated; columns other than those of documents go; an empty table gives an empty result.
    """
    pairs = docs.select(*DOCUMENT_COLUMNS)
    schema = pairs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, letters = b.column("text"), b.column("letters").to_pylist()
            langs, kept = b.column("lang").to_pylist(), np.zeros(len(b), dtype=bool)
            todo = [i for i, ok in enumerate(letters) if ok] if m.languages else []
            for part in _in_batches(texts, todo):
                p = m.probabilities([t for _, t in part])
                for (i, _), k, q in zip(part, p.argmax(axis=1), p.max(axis=1), strict=True):
                    kept[i] = q >= m.threshold
                    langs[i] = langs[i] if langs[i] is not None else m.languages[k]
            b = b.set_column(b.schema.get_field_index("lang"), "lang", pa.array(langs, pa.string()))
            yield b.select(list(DOCUMENT_COLUMNS)).filter(pa.array(kept))

    seen = pairs.withColumn("letters", F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    return seen.mapInArrow(keep, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all rows of documents, learned from those whose crc32(doc_id) mod 4 is not 2.

    Null, empty and letterless texts are ``und`` with score 0; a null id counts as the empty string; texts of any length are read
    whole; ties go to the language that comes first by name; repeated rows stay repeated; other columns are never looked at; an
    empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_languages(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
