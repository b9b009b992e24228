"""Language identification in two steps: the family, then the language within it.

Features are hashed byte bigrams and trigrams of the lower-case text, with everything but
letters as a space. One-versus-rest linear support vector machines tell families apart;
in the family found, one-versus-one machines vote between its languages. A text's score
for a machine is the mean weight of its features, so texts of any length are one pass.

The machines are fitted on a bounded sample of labelled rows: for each language the
`sample` rows whose doc_id and text hash lowest. Their features are counted on the executors;
the driver gets sparse counts, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

UNKNOWN = "und"
SIZE = 1 << 16  # features of either kind
SLICE = 1 << 20
TOGETHER = 1 << 16  # bytes whose weights are looked up at once
#: Families of ISO 639-1 codes; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af", "romance": "fr es it pt ro ca gl", "slavic": "ru uk pl cs sk bg sr hr sl",
    "indic": "hi bn ur mr gu pa", "semitic": "ar he", "sinitic": "zh", "turkic": "tr az kk", "uralic": "fi et hu",
}
OF_LANGUAGE = {x: k for k, v in FAMILIES.items() for x in v.split()}
PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Params:
    """sample: different labelled rows for each language; all languages are learned."""

    sample: int = 1000
    rounds: int = 150
    penalty: float = 1e-3
    slope: float = 3.0


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(data: np.ndarray) -> np.ndarray:
    """For every position but the last two: its bigram, and from SIZE on its hashed trigram."""
    b = data.astype(np.uint32)
    two = (b[:-2] << 8) | b[1:-1]
    three = (((two << 8) | b[2:]) * np.uint32(2654435761)) >> 16
    return np.stack([two, three + SIZE])


def framed(text: str) -> Iterator[np.ndarray]:
    """The bytes of the text, a space at either end, in overlapping slices of bounded size."""
    data = np.frombuffer(b" " + text.lower().encode(errors="replace").translate(PLAIN) + b"  ", np.uint8)
    for at in range(0, len(data) - 2, SLICE):
        yield data[at : at + SLICE + 2]


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    #: (family, None) or (language, other language), in the order of the columns of weights
    machines: list[tuple[str, str | None]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    slope: float = 3.0

    def margins(self, texts: list[str]) -> np.ndarray:
        """The machines' values, a row for each text. Slices of many texts go through together."""
        out, size = np.zeros((len(texts), len(self.machines))), np.zeros(len(texts))
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            data = np.concatenate([x for _, x in group])
            ends = np.cumsum([len(x) for _, x in group])
            begins = np.concatenate([[0], ends[:-1]])
            two, three = features(data)
            two[ends[:-1] - 2] = two[ends[:-1] - 1] = 0  # across two slices: feature 0 never occurs
            three[ends[:-1] - 2] = three[ends[:-1] - 1] = 0
            own = np.add.reduceat(self.weights[two] + self.weights[three], begins, axis=0)
            rows = np.asarray([k for k, _ in group])
            np.add.at(out, rows, own)
            np.add.at(size, rows, ends - begins - 2)

        for k, text in enumerate(texts):
            for x in framed(text):
                group.append((k, x))
                held += len(x)
                if held >= TOGETHER:
                    flush()
                    group, held = [], 0
        if group:
            flush()
        return out / np.maximum(size, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, confidence) of each text; UNKNOWN and 0 without letters or a fitted model."""
        found, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [k for k, t in enumerate(texts) if letters(t)] if self.families else []
        if not rows:
            return found, score
        values = self.margins([texts[k] for k in rows])
        at = {m: k for k, m in enumerate(self.machines)}
        for k, own in zip(rows, values, strict=True):
            sure = 1.0
            family = self.families[0]
            if len(self.families) > 1:
                each = [own[at[f, None]] for f in self.families]
                family = self.families[int(np.argmax(each))]
                sure = 1 / (1 + np.exp(-self.slope * max(each)))
            names = self.languages[family]
            votes = {x: [0, 0.0] for x in names}
            for a, b in combinations(names, 2):
                m = float(own[at[a, b]])
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
            best = max(names, key=lambda x: (*votes[x], x))
            if len(names) > 1:
                sure *= min(1 / (1 + np.exp(-self.slope * (own[at[a, b]] if a == best else -own[at[a, b]]))) for a, b in combinations(names, 2) if best in (a, b))
            found[k], score[k] = best, float(sure)
        return found, score


def svm(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, sign: np.ndarray, size: int, p: Params) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps. The sparse
    input has one entry for each (row, feature), in order of rows; sign is +1 or -1."""
    n = len(sign)
    begins = np.searchsorted(rows, np.arange(n))
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w, last, bias, last_bias = np.zeros(size), np.zeros(size), 0.0, 0.0
    # the loss's curvature is at most twice the largest squared row length, bias included
    step = 1 / (2 * (np.bincount(rows, values**2, minlength=n).max() + 1) + p.penalty)
    for k in range(p.rounds):
        push = k / (k + 3)
        v, c = w + push * (w - last), bias + push * (bias - last_bias)
        gap = np.maximum(0, 1 - sign * (np.add.reduceat(values * v[ids], begins) + c)) * share * sign
        last, last_bias = w, bias
        w = v - step * (p.penalty * v - 2 * np.bincount(ids, values * gap[rows], minlength=size))
        bias = c + step * 2 * gap.sum()
    return w, float(bias)


def fit(labels: list[str], counts: list[tuple[np.ndarray, np.ndarray]], p: Params = Params()) -> Model:
    """From each sampled row's language, features and their counts."""
    if not labels:
        return Model()
    ids = np.concatenate([f for f, _ in counts]).astype(np.int64)
    values = np.concatenate([c / c.sum() for _, c in counts])
    rows = np.repeat(np.arange(len(counts)), [len(f) for f, _ in counts])
    # features are scaled to a like spread; the scale goes into the weights
    mean = np.bincount(ids, values, minlength=2 * SIZE) / len(counts)
    scale = 1 / np.sqrt(mean + 1e-6)
    values = values * scale[ids]
    values /= (top := np.sqrt(np.bincount(rows, values**2).mean()))
    languages: dict[str, list[str]] = {}
    for x in sorted(set(labels)):
        languages.setdefault(OF_LANGUAGE.get(x, x), []).append(x)
    families, names = sorted(languages), np.asarray(labels)
    of = np.asarray([OF_LANGUAGE.get(x, x) for x in labels])
    machines: list[tuple[str, str | None]] = [(f, None) for f in families] if len(families) > 1 else []
    machines += [pair for f in families for pair in combinations(languages[f], 2)]
    weights, bias = np.zeros((2 * SIZE, max(1, len(machines))), np.float32), np.zeros(max(1, len(machines)))
    starts = np.searchsorted(rows, np.arange(len(counts) + 1))
    for k, (a, b) in enumerate(machines):
        use = np.arange(len(labels)) if b is None else np.flatnonzero((names == a) | (names == b))
        sign = np.where((of if b is None else names)[use] == a, 1.0, -1.0)
        part = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in use])
        again = np.repeat(np.arange(len(use)), starts[use + 1] - starts[use])
        w, bias[k] = svm(again, ids[part], values[part], sign, 2 * SIZE, p)
        weights[:, k] = w * scale / top
    weights[0] = 0
    return Model(families, languages, machines or [(families[0], None)], weights, bias, p.slope)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            total = np.zeros(2 * SIZE, np.int64)
            for x in framed(text.as_py()):
                total += np.bincount(features(x).ravel(), minlength=2 * SIZE)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([used.astype("<u4").tobytes()]), pa.array([total[used].astype("<u4").tobytes()])], names=["lang", "ids", "counts"])


def learn(labelled: DataFrame, p: Params = Params()) -> Model:
    """The model from labelled(doc_id, text, lang); rows with a null lang, or whose text is
    null or without letters, teach nothing. No usable row: a model that knows no language."""
    rows = labelled.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("place"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # only the share of a language's rows that holds its lowest hashes, with room to spare, is
    # ranked; rows that repeat have one place
    spark = labelled.sparkSession
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()  # a row for each language, as the model has
    share = F.broadcast(spark.createDataFrame([(r.lang, 3.0 * p.sample / r.n) for r in counts], "lang string, share double"))
    low = rows.select("lang", "place").join(share, "lang").where(F.col("place") / F.lit(2.0**63) <= F.col("share")).select("lang", "place").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    last = low.withColumn("k", rank).where(F.col("k") <= p.sample).groupBy("lang").agg(F.max("place").alias("last"))
    last = F.broadcast(spark.createDataFrame(last.collect(), "lang string, last long"))
    sample = rows.join(last, "lang").where(F.col("place") <= F.col("last")).groupBy("lang", "place").agg(F.first("text").alias("text")).select("lang", "text")
    got = sample.mapInArrow(_count, "lang string, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.ids), bytes(r.counts)))
    return fit([r.lang for r in got], [(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.counts, "<u4").astype(np.float64)) for r in got], p)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found, score = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, *ADDED])
        give_back()

    return run


#: The columns that predicted() adds; columns of docs with such names are replaced.
ADDED = ["lang_pred", "lang_score"]


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1) after its own columns. A null or empty
    text, or one without letters, is `und` with score 0. Rows depend on their text only."""
    docs = docs.drop(*ADDED)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(_predict(model), ", ".join([*kinds, "lang_pred string", "lang_score double"]))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text has a language, with docs' columns. Columns named as
    those of predicted() are let past it under other names."""
    inner = docs.toDF(*(f"c{k}" if c != "text" else "text" for k, c in enumerate(docs.columns)))
    return predicted(inner, model).where(F.col("lang_pred") != UNKNOWN).drop(*ADDED).toDF(*docs.columns)
