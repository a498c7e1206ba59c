"""Language identification with string kernels.

The kernel counts the distinct character n-grams of one to three letters that
two texts share (presence, not frequency), over the root of the product of both
numbers of n-grams.  A bounded stratified sample of labelled texts gives the
landmarks of a Nyström map; one-versus-rest kernel ridge regression is fitted in
the mapped space.  As the kernel is linear in n-gram presence, the landmarks'
presence matrix, the map and the ridge weights fold into one matrix from
n-grams to classes; a batch of texts is scored by one product with it.

Prediction sees the text only.  Null texts and texts without a letter are "und"
with score 0; so is everything where no labelled text exists.  Other columns of
the input, also those named like the output's, are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship

#: Bound of the labelled sample: texts and landmarks of a class, and of all classes together (these share them evenly).
PER_CLASS, LANDMARKS, ALL_TEXTS, ALL_LANDMARKS = 256, 64, 50_000, 4_000
#: N-grams whose presence is held as a dense block at once.
COLUMNS = 4_096
#: Ridge strength per training text.
RIDGE = 1e-4
UND = "und"
_TOP = 0x33480  # no letters beyond
_tables: list[np.ndarray] = []


def letter_tables() -> list[np.ndarray]:
    """By code point: is it a letter; does it stay in the n-grams (letters and marks)."""
    if not _tables:
        kind = [unicodedata.category(chr(c))[0] for c in range(_TOP)]
        _tables[:] = [np.array([k == "L" for k in kind] + [False]), np.array([k in "LM" for k in kind] + [False])]
    return _tables


def ngrams(text: str | None) -> np.ndarray | None:
    """Sorted distinct n-grams as numbers of 21 bits a character; None without a letter."""
    if not text:
        return None
    letter, stays = letter_tables()
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    at = np.minimum(c, _TOP)
    if not letter[at].any():
        return None
    c = np.where(stays[at], c, 32).astype(np.int64)
    c = np.concatenate([[32], c, [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = c[:-1] << 21 | c[1:]
    return np.unique(np.concatenate([c, two, two[:-1] << 21 | c[2:]]))


def _sample(docs: DataFrame, key: str, text: str, lang: str, train: Column) -> list[tuple[str, int, np.ndarray]]:
    """A bounded sample of labelled texts as (class, hash, n-grams), drawn row by row by a hash of key and text."""
    rows = docs.filter(train & docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].alias("lang"), F.xxhash64(docs[key], docs[text]).alias("h"), docs[text].alias("t"))
    sizes = cut(rows.groupBy("lang").count(), "languages", small=True)
    classes = sizes.count()
    if not classes:
        return []
    per_class = max(1, min(PER_CLASS, ALL_TEXTS // classes))
    rows = rows.join(F.broadcast(sizes) if classes <= ALL_TEXTS else sizes, "lang")
    share = F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("count"))
    unit = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(a.as_py(), h.as_py(), g) for a, h, t in zip(b.column(0), b.column(1), b.column(2), strict=True) if (g := ngrams(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2].tobytes() for x in found], pa.binary())], names=["lang", "h", "grams"])

    drawn = rows.filter(unit < share).select("lang", "h", "t").mapInArrow(run, "lang string, h long, grams binary")
    # ALL_TEXTS rows are expected at most; the limit, of least hash, only guards against a hash that draws far more.
    return [(r[0], r[1], np.frombuffer(r[2], np.int64)) for r in drawn.orderBy("h", "lang").limit(2 * ALL_TEXTS).collect()]


class Model:
    """classes, vocabulary (sorted n-grams of the landmarks), weights (n-gram by class), bias."""

    def __init__(self, sample: list[tuple[str, int, np.ndarray]]):
        sample = sorted(sample, key=lambda x: (x[0], x[1], x[2].tobytes()))
        self.classes = sorted({x[0] for x in sample})
        kept, seen, most = [], dict.fromkeys(self.classes, 0), max(1, min(LANDMARKS, ALL_LANDMARKS // len(self.classes)))
        for x in sample:
            if seen[x[0]] < most:
                seen[x[0]] += 1
                kept.append(x[2])
        self.vocabulary = np.unique(np.concatenate(kept))
        every = [x[2] for x in sample]
        shared, own = np.zeros((len(every), len(kept))), np.zeros((len(kept), len(kept)))
        for at in range(0, len(self.vocabulary), COLUMNS):
            marks = self._presence(kept, at, COLUMNS)
            own += marks @ marks.T
            shared += np.vstack([self._presence(every[i : i + 512], at, COLUMNS) @ marks.T for i in range(0, len(every), 512)])
        scale = 1 / np.sqrt([len(g) for g in kept])
        power, axes = np.linalg.eigh(own * scale[:, None] * scale)
        good = power > 1e-8 * power[-1]
        nystrom = axes[:, good] / np.sqrt(power[good])
        rows = shared * scale / np.sqrt([[len(g)] for g in every]) @ nystrom
        truth = np.array([[float(x[0] == c) for c in self.classes] for x in sample])
        middle, mean = rows.mean(0), truth.mean(0)
        x = rows - middle
        ridge = np.linalg.solve(x.T @ x + RIDGE * len(x) * np.eye(x.shape[1]), x.T @ (truth - mean))
        to_class = scale[:, None] * (nystrom @ ridge)
        self.weights = np.vstack([self._presence(kept, at, COLUMNS).T @ to_class for at in range(0, len(self.vocabulary), COLUMNS)])
        self.bias = mean - middle @ ridge

    def _presence(self, grams: list[np.ndarray], first: int = 0, most: int | None = None) -> np.ndarray:
        """Texts by n-grams of the vocabulary, of which ``most`` from place ``first`` on."""
        part = self.vocabulary[first:] if most is None else self.vocabulary[first : first + most]
        out = np.zeros((len(grams), len(part)))
        for row, g in zip(out, grams, strict=True):
            at = np.searchsorted(part, g)
            at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == g)]
            row[at] = 1.0
        return out

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        return self._presence(grams) @ self.weights / np.sqrt([[len(g)] for g in grams]) + self.bias


def train_model(docs: DataFrame, text: str = "text", lang: str = "lang", train: Column | None = None, key: str = "doc_id") -> Model | None:
    """The model of a bounded sample; the key only decides which rows are drawn."""
    ship(docs.sparkSession)
    sample = _sample(docs, key, text, lang, F.lit(True) if train is None else train)
    return Model(sample) if sample else None


def predict_language(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the carried columns, lang_pred, score for each row."""
    ship(docs.sparkSession)
    source = docs.select(docs[text].alias("t"), docs[key].alias("k"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))
    names = [key, *carry]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, source.schema[1:], strict=True)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                grams = [ngrams(t.as_py()) for t in b.column(0)]
                known = [i for i, g in enumerate(grams) if g is not None and model is not None]
                lang, score = [UND] * len(grams), [0.0] * len(grams)
                if known:
                    s = model.scores([grams[i] for i in known])
                    for i, row in zip(known, s, strict=True):
                        best = int(row.argmax())
                        lang[i], score[i] = model.classes[best], round(float(min(1.0, max(0.0, row[best]))), 6)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)
