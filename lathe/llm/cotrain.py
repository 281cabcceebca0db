"""A quality classifier by co-training: one view of a page's words and characters, one of its metadata and layout, teaching each other.

Two logistic models start from the same labelled documents. One sees the text's content (shares of byte classes, measures
of words, and which of 64 hashed groups its words fall into), the other the page's metadata (language, source, length)
and its layout (lines, their length and repetition, bars and breaks). In each round either scores all unlabelled documents; the most
certain ones, by rank for each class and a share of all that grows from round to round, become pseudo-labels for the
other view. Each counts by as much as the view's calibrated probability beats the prior, so that a view that knows little
teaches little, and not where the other has more evidence against it; all together count at most a quarter of the labels. Each model's logits are calibrated on labelled
documents that neither was fitted on; the calibrated logits, weighted by a third fit on the same documents, give the
score of every document.

Only labels are sampled: the models start from at most ``LABELLED`` labelled documents, those with the least hashes of
their ids, which reach the driver. Ranks and pseudo-labels cover every unlabelled document: counts of scores, and sums of
Newton's gradients and Hessians, are made in the tasks and added up by Spark, so what reaches the driver has a fixed size.

Defined cases: documents labelled both ways, or with a null label, count as unlabelled; null texts are empty, null
metadata is a value of its own, null ids never have a label; without labels of both kinds every document gets the
share of good ones among the labels (1 if there are none); repeated rows get equal scores; other columns are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from lathe.llm import common

#: Bound of the labelled sample that is gathered to start the models: some MB of figures.
LABELLED = 6000
ROUNDS, STEPS = 3, 2
#: The share of the unlabelled documents that each view labels in the first round; as much again in each further one.
GROWTH = 0.1
#: What all pseudo-labels together weigh at most, in labels.
TAUGHT = 0.25
KEEP = 0.5
BINS = 8
SOURCES, WORDS = 64, 64
#: Up to so many labels are broadcast (some 30 MB); more are joined by shuffle.
BROADCAST_LABELS = 500_000
#: Steps of a logit in counts of scores.
_FINE, _MOST = 32, 12

_CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" ", b"\n", b"|", b"#$%&*@^~<>=+_", b"!?", b".,;:'\"()-", bytes(range(128, 256))]
N_FIGURES = len(_CLASSES) + 10
#: Figures that tell of layout: line breaks, bars, length in bytes and words, words in a line, share of unlike lines.
LAYOUT = [4, 5, 10, 11, 18, 19]
CONTENT = [k for k in range(N_FIGURES) if k not in LAYOUT]


def figures(text: str) -> tuple[list[float], bytes]:
    """Shares of byte classes and measures of words and lines, each over the whole text; and for 64 groups of words, by hash, the share of unlike words in each (in 255ths)."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    out = [(len(data) - len(data.translate(None, c))) / n for c in _CLASSES]
    words = data.split()
    k = max(1, len(words))
    unlike = set(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(1 for w in words if w[-1:] in b"#$%&*!|")
    groups = np.bincount(np.fromiter(map(xxh32_intdigest, unlike), dtype=np.uint32, count=len(unlike)) % WORDS, minlength=WORDS)
    shares = np.rint(groups * 255 / max(1, len(unlike))).astype(np.uint8).tobytes()
    return [*out, np.log1p(len(data)), np.log1p(len(words)), len(data) / k, len(unlike) / k, repeats / k, marked / k, sum(map(bytes.isupper, words)) / k, sum(map(bytes.istitle, words)) / k, k / m, len(set(lines)) / m], shares


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> tuple[str, int, float]:
    """Language, one of so many groups of sources, and the order of length (-1: unknown)."""
    return lang or "", zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % SOURCES, -1.0 if n_chars is None or n_chars < 0 else float(np.log2(n_chars + 1))


class Logistic:
    """Logistic regression with a ridge, by Newton's steps; weights may differ by row."""

    def __init__(self, ridge: float = 1.0):
        self.ridge, self.w = ridge, np.zeros(1)

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the loss at the present weights, without the ridge."""
        x = np.column_stack([np.ones(len(x)), x])
        p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
        return x.T @ (weight * (p - y)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x

    def step(self, gradient: np.ndarray, hessian: np.ndarray) -> float:
        ridge = np.full(len(self.w), self.ridge)
        ridge[0] = 1e-6
        step = np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * self.w)
        self.w = self.w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        return np.abs(step).max()

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            if self.step(*self.sums(x, y, np.ones(len(x)) if weight is None else weight)) < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + x @ self.w[1:], -_MOST, _MOST)


def _softened(y: np.ndarray) -> np.ndarray:
    """Platt's targets: labels drawn in by what their number leaves open, so that separable scores stay calibrated."""
    good, bad = y.sum(), len(y) - y.sum()
    return np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Figures, word groups, metadata and labels (nan: none) of some documents."""

    def __init__(self, figures: list, words: list, meta: list[tuple], labels: list):
        self.x = np.asarray(figures, dtype=float).reshape(-1, N_FIGURES)
        self.words = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, WORDS) / 255.0
        self.meta = meta
        self.y = np.array([np.nan if v is None else float(v) for v in labels])


class Steps:
    """Columns, standardised, and which of some quantiles of the sample they exceed: so effects need not be linear."""

    def __init__(self, x: np.ndarray):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.edges = [np.unique(np.quantile(x[:, k], [*np.arange(1, BINS) / BINS, 0.01, 0.03, 0.97, 0.99])) for k in range(x.shape[1])]

    def encode(self, x: np.ndarray) -> np.ndarray:
        steps = [x[:, k : k + 1] > e for k, e in enumerate(self.edges)]
        return np.column_stack([np.clip((x - self.mean) / self.std, -4, 4), *steps]).astype(float)


class TextView:
    def __init__(self, rows: Rows):
        self.steps = Steps(rows.x[:, CONTENT])
        self.mean, self.std = rows.words.mean(axis=0), rows.words.std(axis=0) + 1e-3

    def encode(self, rows: Rows) -> np.ndarray:
        return np.column_stack([self.steps.encode(rows.x[:, CONTENT]), np.clip((rows.words - self.mean) / self.std, -4, 4) / 8])


class MetadataView:
    def __init__(self, rows: Rows):
        self.steps = Steps(rows.x[:, LAYOUT])
        self.langs = {v: k for k, v in enumerate(sorted({r[0] for r in rows.meta})[:50])}

    def encode(self, rows: Rows) -> np.ndarray:
        out = np.zeros((len(rows.meta), len(self.langs) + 1 + SOURCES + 22))
        for i, (lang, source, size) in enumerate(rows.meta):
            out[i, self.langs.get(lang, len(self.langs))] = 1
            out[i, len(self.langs) + 1 + source] = 1
            out[i, len(self.langs) + 1 + SOURCES + min(21, int(size) + 1)] = 1
        return np.column_stack([self.steps.encode(rows.x[:, LAYOUT]), out])


class CoTrained:
    """Both views fitted, calibrated and combined. ``prior`` alone where there is nothing to fit.

    ``everything``, if given, answers for all unlabelled documents: ``counts(model)`` of their calibrated logits by view, and
    ``sums(model, low, high)``, for each view gradient, Hessian, weight and number of the pseudo-labels that the other gives it.
    """

    def __init__(self, sample: Rows, everything: Everything | None = None, rounds: int = ROUNDS, growth: float = GROWTH):
        y = sample.y
        self.prior = float(y.mean()) if len(y) else 1.0
        self.fitted = len(y) >= 8 and 0 < self.prior < 1
        #: Documents that each view gave pseudo-labels to, by round.
        self.history: list[tuple[int, int]] = []
        if not self.fitted:
            return
        self.views = (TextView(sample), MetadataView(sample))
        x = [v.encode(sample) for v in self.views]
        held = np.zeros(len(y), dtype=bool)
        held[::4] = True
        if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
            held[:] = False
        train = np.flatnonzero(~held)
        judge = np.flatnonzero(held) if held.any() else train
        one = np.ones(len(train))
        self.models = [Logistic(3.0).fit(x[v][train], y[train]) for v in range(2)]
        self._calibrate(x, y, judge)
        for at in range(rounds if everything else 0):
            low, high = zip(*(self._extremes(c, growth * (at + 1)) for c in everything.counts(self)), strict=True)
            taught = [Logistic(3.0), Logistic(3.0)]
            for v in range(2):
                taught[v].w = self.models[v].w.copy()
            for _ in range(STEPS):
                found = everything.sums(self, low, high, taught)
                for v in range(2):
                    gradient, hessian, weight, _ = found[v]
                    share = min(1.0, TAUGHT * len(train) / max(weight, 1e-9))
                    own = taught[v].sums(x[v][train], y[train], one)
                    taught[v].step(own[0] + share * gradient, own[1] + share * hessian)
            self.history.append((found[1][3], found[0][3]))
            self.models = taught
            self._calibrate(x, y, judge)
        self.top = Logistic(1.0).fit(np.column_stack(self.calibrated(sample)[1])[judge], _softened(y[judge]))

    def _calibrate(self, x: list[np.ndarray], y: np.ndarray, judge: np.ndarray) -> None:
        self.scales = [Logistic(1.0).fit(self.models[v].logit(x[v][judge])[:, None], _softened(y[judge])) for v in range(2)]

    def _extremes(self, counts: np.ndarray, share: float) -> tuple[float, float]:
        """Logits up to which, and from which on, the most certain documents of either class lie: at most their share of the class, one step at least."""
        total = counts.sum()
        if not total:
            return -np.inf, np.inf
        bad = np.searchsorted(np.cumsum(counts), share * (1 - self.prior) * total, side="right") - 1
        good = np.searchsorted(np.cumsum(counts[::-1]), share * self.prior * total, side="right") - 1
        some = np.flatnonzero(counts)
        bad, good = max(bad, some[0]), min(len(counts) - 1 - good, some[-1])
        return (bad + 1) / _FINE - _MOST, max(good, bad + 1) / _FINE - _MOST

    def calibrated(self, rows: Rows) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What each view sees, and its calibrated logits."""
        x = [v.encode(rows) for v in self.views]
        return x, [s.logit(m.logit(e)[:, None]) for e, m, s in zip(x, self.models, self.scales, strict=True)]

    def pseudo_labels(self, z: np.ndarray, other: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Of documents that a view is sure of: labels, and weights by how far its probability beats the prior.

        Weight 0 for all others, and where the ``other`` view has more evidence (over the prior) for the other class.
        """
        p, prior = _sigmoid(z), np.log(self.prior / (1 - self.prior))
        weight = np.where(z >= high, (p - self.prior) / (1 - self.prior), np.where(z < low, (self.prior - p) / self.prior, 0.0))
        against = ((z - prior) * (other - prior) < 0) & (np.abs(other - prior) > np.abs(z - prior))
        return (z >= high).astype(float), np.where(against, 0.0, np.maximum(weight, 0.0))

    def scores(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: by its text, by its metadata, by both."""
        if not self.fitted or not len(rows.x):
            return (np.full(len(rows.x), self.prior),) * 3
        _, z = self.calibrated(rows)
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(self.top.logit(np.column_stack(z)))


_SEEN = ["figures", "words", "lang", "source", "n_chars"]
_SEEN_SQL = "figures array<float>, words binary, lang string, source string, n_chars long"


def _rows(b: pa.RecordBatch, prefix: str = "") -> Rows:
    figs, words, *meta = (b.column(prefix + c).to_pylist() for c in _SEEN)
    labels = b.column("label").to_pylist() if "label" in b.schema.names else [None] * b.num_rows
    return Rows(figs, words, [metadata(*r) for r in zip(*meta, strict=True)], labels)


class Everything:
    """All unlabelled documents of a table of figures, scored and summed by Spark."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _summed(self, model: CoTrained, work: Callable) -> dict[tuple[int, int], float]:
        shared = self.table.sparkSession.sparkContext.broadcast(model)  # some 100 kB

        def run(batches):
            totals: list[np.ndarray] = []
            for b in batches:
                rows = _rows(b)
                found = work(shared.value, rows)
                totals = [a + f for a, f in zip(totals, found, strict=True)] if totals else found
            for v, t in enumerate(totals):
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at].astype(float))], names=["view", "at", "value"])

        rows = common.in_batches(self.table.where("label is null").drop("label"), run, "view int, at int, value double")
        return {(r[0], r[1]): r[2] for r in rows.groupBy("view", "at").agg(F.sum("value")).collect()}

    def counts(self, model: CoTrained) -> list[np.ndarray]:
        size = 2 * _MOST * _FINE

        def work(m: CoTrained, rows: Rows) -> list[np.ndarray]:
            return [np.bincount(np.clip(((z + _MOST) * _FINE).astype(int), 0, size - 1), minlength=size).astype(float) for z in m.calibrated(rows)[1]]

        found = self._summed(model, work)
        return [np.array([found.get((v, k), 0.0) for k in range(size)]) for v in range(2)]

    def sums(self, model: CoTrained, low: tuple, high: tuple, taught: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
        sizes = [len(m.w) for m in taught]

        def work(m: CoTrained, rows: Rows) -> list[np.ndarray]:
            x, z = m.calibrated(rows)
            out = []
            for v in range(2):
                y, weight = m.pseudo_labels(z[1 - v], z[v], low[1 - v], high[1 - v])
                some = weight > 0
                gradient, hessian = taught[v].sums(x[v][some], y[some], weight[some])
                out.append(np.concatenate([[weight.sum(), some.sum()], gradient, hessian.ravel()]))
            return out

        found = self._summed(model, work)
        out = []
        for v, d in enumerate(sizes):
            flat = np.zeros(2 + d + d * d)
            for (view, at), value in found.items():
                if view == v:
                    flat[at] = value
            out.append((flat[2 : 2 + d], flat[2 + d :].reshape(d, d), float(flat[0]), int(flat[1])))
        return out


def figured(docs: DataFrame, keep: bool = False) -> DataFrame:
    """A stored table (doc_id, figures, words, lang, source, n_chars): some 250 bytes a document, read for the fit and the scores.

    With ``keep`` it has the columns of ``docs`` instead of doc_id, as they are, and the others as ``__lathe_<name>``: so
    that figures are computed once where documents are to be kept or left out by their scores.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = lambda c, t: F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)
    prefix = "__lathe_" if keep else ""
    n_chars = has("n_chars", "long") if "n_chars" in docs.columns else F.char_length(text).cast("long")
    own = [F.col(f"`{c}`") for c in docs.columns] if keep else [F.col("doc_id").cast("long").alias("doc_id")]
    seen = docs.select(*own, text.alias("__lathe_read"), has("lang", "string").alias(f"{prefix}lang"), has("source", "string").alias(f"{prefix}source"), n_chars.alias(f"{prefix}n_chars"))
    n = len(own)
    added = T.StructType.fromDDL(_SEEN_SQL)
    schema = T.StructType([*seen.schema.fields[:n], *(T.StructField(prefix + f.name, f.dataType) for f in added.fields)])

    def run(batches):
        for b in batches:
            rows = [figures(x) for x in b.column(n).to_pylist()]
            made = [pa.array([r[0] for r in rows], pa.list_(pa.float32())), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made, *b.columns[n + 1 :]], names=schema.names)

    return common.stored(common.in_batches(seen, run, schema), "figures")


def labelled(table: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """A stored table: ``table`` with ``label``, null where there is none or both."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high").select("doc_id", F.col("low").alias("label"))
    few = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return common.stored(table.select("doc_id", *_SEEN).join(F.broadcast(marks) if few else marks, "doc_id", "left"), "labelled")


def fit(table: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = LABELLED, **settings: float) -> CoTrained:
    """The models from a table of figures and (doc_id, label)."""
    marked = labelled(table, labels, label_col)
    order = [F.xxhash64(F.lit("co-training"), "doc_id"), F.col("doc_id"), F.col("figures"), F.col("words"), F.col("lang"), F.col("source"), F.col("n_chars")]
    rows = marked.where("label is not null").orderBy(*order).limit(sample).collect()
    start = Rows([r["figures"] for r in rows], [bytes(r["words"]) for r in rows], [metadata(r["lang"], r["source"], r["n_chars"]) for r in rows], [r["label"] for r in rows])
    return CoTrained(start, Everything(marked), **settings)


def scored(table: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, text_score, metadata_score, score) from a table of figures; to 6 digits, which the order of sums doesn't reach."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = shared.value.scores(_rows(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.round(v, 6), pa.float64()) for v in found)], names=["doc_id", "text_score", "metadata_score", "score"])

    return common.in_batches(table, run, "doc_id long, text_score double, metadata_score double, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    table = figured(docs, keep=True)
    shared = docs.sparkSession.sparkContext.broadcast(fit(table.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"__lathe_{c}").alias(c) for c in _SEEN)), labels))
    n = len(docs.columns)

    def run(batches):
        for b in batches:
            score = np.round(shared.value.scores(_rows(b, "__lathe_"))[2], 6)
            yield pa.RecordBatch.from_arrays(b.columns[:n], names=b.schema.names[:n]).filter(pa.array(score >= least))

    return common.in_batches(table, run, docs.schema)


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = figured(common.documents(spark, sf_dir))
    model = fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(table, model).withColumn("keep", F.col("score") >= KEEP)
