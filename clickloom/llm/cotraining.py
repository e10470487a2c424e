"""Quality classifier by co-training on two views of a document.

One classifier sees the text (words, endings, shapes of words, kinds of characters), the other the page's
metadata (language, source, declared size, number and length of lines). In each round each view labels, for
the other, those documents of the whole table of which it is most confident; then both are trained on
the labelled sample and on what the other one taught. Both are calibrated on labelled documents that neither was
trained on, and the sum of their calibrated log odds (the prior counted once) scores every document.

Only the labelled side is bounded: `labelled` documents a class, those with the smallest hashes of their ids, a fifth
of them held out. Every other document takes part in each round: its features are written once,
a pass counts log odds in fixed bins, which give the share that may teach, another writes what is taught,
and each step of training sums gradients of a fixed size per task. These sums are of whole
numbers, so the result does not depend on how rows are dealt to tasks.

Defined cases: a null text is empty; null metadata counts as a value of its own. Of several labels of a
document the largest counts, of several rows of a labelled id one is learned from. Rows without an id are
unlabelled. If the sample lacks one of the classes nothing can be learned: scores are null and every document is
kept. Repeated rows get the same score; other columns stay, those named like a score are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Generator, Iterator
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.arrow import Step, mapped, with_columns
from clickloom.sources.staging import Staging

LABELLED = 4_000
ROUNDS = 3
CONFIDENT = 0.95
# Share of the table that may be taught per class; each round adds as much again.
SHARE = 0.05
# Steps of training before the first round, and with the table's gradients in each round.
STEPS, ROUND_STEPS = 60, 8
PENALTY = 1e-5
# Share of held-out good documents that the cut must keep.
KEEP_GOOD = 0.995

WORDS, ENDINGS, SHAPES = 1 << 12, 1 << 9, 1 << 8
LANGUAGES, SOURCES, SIZES = 1 << 8, 1 << 12, 1 << 8
CHARACTERS = (
    ("capitals", slice(65, 91)),
    ("digits", slice(48, 58)),
    ("marks", slice(33, 48)),
    ("late marks", slice(58, 65)),
    ("brackets", slice(91, 97)),
    ("braces", slice(123, 128)),
    ("beyond ASCII", slice(128, 256)),
)
VIEWS = ("content", "metadata")
PLACES = (1 + WORDS + ENDINGS + SHAPES + len(CHARACTERS), 1 + LANGUAGES + SOURCES + 3 * SIZES)
# A feature of 1 is stored as ONE; weights and errors are rounded to whole multiples of 1 / UNIT.
ONE, UNIT = 255, 1 << 20
BINS, BIN = 2_000, 0.02
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64

FEATURES = [T.StructField(f"{view}_{part}", T.BinaryType()) for view in VIEWS for part in ("at", "by")]
TAUGHT = [T.StructField(f"{view}_taught", T.IntegerType()) for view in VIEWS]
COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in ("view", "label", "place", "n")])
SCORES = [
    T.StructField("content_score", T.DoubleType()),
    T.StructField("metadata_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("keep", T.BooleanType()),
]


class Rows(NamedTuple):
    """Sparse rows of one view: their places and values, and where each row begins. No row is empty,
    as place 0 stands for the constant."""

    at: np.ndarray
    by: np.ndarray
    starts: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Exact products of whole numbers."""
        return np.add.reduceat(weights[self.at] * self.by, self.starts) if len(self.starts) else np.zeros(0, np.int64)

    def sums(self, errors: np.ndarray, places: int) -> np.ndarray:
        """Per place the sum of a row's error times its value."""
        lengths = np.diff(np.append(self.starts, len(self.at)))
        total = np.zeros(places, np.int64)
        np.add.at(total, self.at, np.repeat(errors, lengths) * self.by)
        return total


class Linear(NamedTuple):
    """A linear model in whole multiples of 1 / UNIT, with a calibrated slope and shift of its log odds."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights) / (ONE * UNIT)

    def odds(self, rows: Rows) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


class Model(NamedTuple):
    content: Linear
    metadata: Linear
    prior: float
    cut: float

    def odds(self, content: Rows, metadata: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both views' log odds and those of both, the prior counted once."""
        one, two = self.content.odds(content), self.metadata.odds(metadata)
        return one, two, one + two - self.prior


def logistic(odds: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -50, 50)))


def shape(word: str) -> str:
    """Kinds of a word's characters in the order in which they first come; the usual ones at once."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word.istitle():
            return "Aa"
    return "".join(dict.fromkeys("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


class WordCodes(dict):
    """Word to one number for the hashes of the word itself, its ending and its shape."""

    def __missing__(self, word: str) -> int:
        small = word.lower().encode("utf-8", "surrogatepass")
        last = word[-1]
        form = shape(word) if last.isalpha() else shape(word[:-1]) + last
        code = (crc32(small) % WORDS * ENDINGS + crc32(small[-3:], 1) % ENDINGS) * SHAPES
        code += crc32(form.encode("utf-8", "surrogatepass"), 2) % SHAPES
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = code
        return code


@lru_cache(maxsize=1)
def _word_codes() -> WordCodes:
    return WordCodes()


def _roots(counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that occur and the square roots of their shares, none rounded to nothing."""
    at = counts.nonzero()[0]
    return at, np.maximum(np.rint(ONE * np.sqrt(counts[at] / total)), 1)


def content_features(text: str) -> tuple[bytes, bytes]:
    """Square roots of the shares of hashed words, endings and shapes, and of kinds of characters."""
    at, by = [np.zeros(1, np.int64)], [np.full(1, ONE)]
    words = Counter(text.split())
    if words:
        codes = np.fromiter(map(_word_codes().__getitem__, words), np.int64, len(words))
        times = np.fromiter(words.values(), np.int64, len(words))
        base = 1
        for hashes, width in ((codes // (ENDINGS * SHAPES), WORDS), (codes // SHAPES % ENDINGS, ENDINGS), (codes % SHAPES, SHAPES)):
            found, roots = _roots(np.bincount(hashes, times, width), int(times.sum()))
            at.append(base + found), by.append(roots)
            base += width
    points = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(points):
        kinds = np.bincount(points, minlength=256)
        found, roots = _roots(np.array([kinds[part].sum() for _, part in CHARACTERS]), len(points))
        at.append(1 + WORDS + ENDINGS + SHAPES + found), by.append(roots)
    return np.concatenate(at).astype(np.uint16).tobytes(), np.concatenate(by).astype(np.uint8).tobytes()


def size_bin(size: float) -> int:
    """Quarters of a doubling; 0 is kept for an absent size."""
    return min(1 + int(4 * np.log2(1 + max(size, 0))), SIZES - 1)


def metadata_features(lang: str | None, source: str | None, n_chars: int | None, text: str) -> tuple[bytes, bytes]:
    """Language and source as hashed places, sizes by doublings."""
    lines = text.count("\n") + 1
    sizes = (0 if n_chars is None else size_bin(n_chars), size_bin(lines), size_bin(len(text) / lines))
    names = [0 if name is None else 1 + crc32(name.encode("utf-8", "surrogatepass")) % (width - 1) for name, width in ((lang, LANGUAGES), (source, SOURCES))]
    base = 1 + LANGUAGES + SOURCES
    at = np.array([0, 1 + names[0], 1 + LANGUAGES + names[1], *(base + i * SIZES + size for i, size in enumerate(sizes))], np.uint16)
    return at.tobytes(), bytes([ONE]) * len(at)


def featured(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    """Both views of each row of a batch."""
    columns = [batch.column(name).to_pylist() for name in ("lang", "source", "n_chars", "text")]
    rows = [
        (*content_features(text or ""), *metadata_features(lang, source, n_chars, text or ""))
        for lang, source, n_chars, text in zip(*columns, strict=True)
    ]
    return {field.name: [row[i] for row in rows] for i, field in enumerate(FEATURES)}


def featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield with_columns(batch, {name: pa.array(values, pa.binary()) for name, values in featured(batch).items()})


def views_of(columns: dict[str, list[bytes]]) -> list[Rows]:
    views = []
    for view in VIEWS:
        values = columns[f"{view}_by"]
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        at = np.frombuffer(b"".join(columns[f"{view}_at"]), np.uint16).astype(np.int64)
        views.append(Rows(at, np.frombuffer(b"".join(values), np.uint8).astype(np.int64), np.cumsum(lengths) - lengths))
    return views


def _columns(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    return {field.name: batch.column(field.name).to_pylist() for field in FEATURES}


def some(rows: Rows, chosen: np.ndarray) -> Rows:
    """The rows for which `chosen` is true."""
    lengths = np.diff(np.append(rows.starts, len(rows.at)))
    inside = np.repeat(chosen, lengths)
    kept = lengths[chosen]
    return Rows(rows.at[inside], rows.by[inside], np.cumsum(kept) - kept)


# Training. A gradient is kept apart by label: (rows, sum of losses, sums per place), the last two in 1 / UNIT.

Gradient = dict[int, tuple[int, int, np.ndarray]]


def gradient(weights: np.ndarray, rows: Rows, target: np.ndarray, places: int) -> Gradient:
    raw = rows.dot(weights) / (ONE * UNIT)
    p = logistic(raw)
    found = {}
    for label in (0, 1):
        own = target == label
        signed = raw[own] if label else -raw[own]
        losses = np.rint(np.logaddexp(0, -signed) * UNIT).astype(np.int64)
        errors = np.rint((p[own] - label) * UNIT).astype(np.int64)
        found[label] = (int(own.sum()), int(losses.sum()), some(rows, own).sums(errors, places))
    return found


def balanced(found: Gradient) -> tuple[float, np.ndarray | float]:
    """Mean loss and its gradient, both labels weighing alike whatever their numbers."""
    parts = [(loss / (n * UNIT), sums / (n * UNIT * ONE)) for n, loss, sums in found.values() if n]
    if not parts:
        return 0.0, 0.0
    return sum(loss for loss, _ in parts) / len(parts), sum(sums for _, sums in parts) / len(parts)


def minimiser(start: np.ndarray, steps: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps: yields the weights whose loss and gradient it wants next.
    A step that raises the loss is halved."""
    best, step, moves = start, None, []
    loss, slope = yield best
    for _ in range(steps):
        if step is None:
            step = -_bent(slope, moves)
        trial = best + step
        new_loss, new_slope = yield trial
        if new_loss > loss:
            step = step / 2
            continue
        change = new_slope - slope
        if step @ change > 1e-12:
            moves = [*moves[-9:], (step, change)]
        best, loss, slope, step = trial, new_loss, new_slope, None
    return best


def _bent(slope: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse curvature that the last moves tell of."""
    turned, shares = slope.copy(), []
    for move, change in reversed(moves):
        share = (move @ turned) / (move @ change)
        turned = turned - share * change
        shares.append(share)
    if moves:
        move, change = moves[-1]
        turned = turned * ((move @ change) / (change @ change))
    for (move, change), share in zip(moves, reversed(shares), strict=True):
        turned = turned + move * (share - (change @ turned) / (move @ change))
    return turned


def rounded(weights: np.ndarray) -> np.ndarray:
    return np.rint(weights * UNIT).astype(np.int64)


Taught = Callable[[list[np.ndarray]], list[Gradient]]


def train_views(views: list[Rows], target: np.ndarray, starts: list[np.ndarray], steps: int, taught: Taught | None) -> list[np.ndarray]:
    """Weights of both views, trained in step; `taught` gives the gradients over what was taught."""
    runs = [minimiser(start, steps) for start in starts]
    asked, results = [next(run) for run in runs], [None] * len(runs)
    while any(result is None for result in results):
        whole = [rounded(weights) for weights in asked]
        others = taught(whole) if taught else [{} for _ in runs]
        for i, run in enumerate(runs):
            if results[i] is not None:
                continue
            weights = whole[i] / UNIT
            loss, slope = balanced(gradient(whole[i], views[i], target, PLACES[i]))
            more_loss, more_slope = balanced(others[i])
            ridge = PENALTY * weights * (np.arange(len(weights)) > 0)
            try:
                asked[i] = run.send((loss + more_loss + ridge @ weights / 2, slope + more_slope + ridge))
            except StopIteration as end:
                results[i] = end.value
    return results


def calibrated(weights: np.ndarray, rows: Rows, target: np.ndarray, weight: np.ndarray) -> Linear:
    """Slope and shift of the log odds, by Newton steps with a little smoothing of the target."""
    model = Linear(weights)
    raw = model.raw(rows)
    good, bad = target.sum(), len(target) - target.sum()
    smooth = np.where(target > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = max(float(raw.std()), 1e-6)
    design = np.stack([raw / spread, np.ones_like(raw)], 1)
    state = np.array([1.0, 0.0])
    for _ in range(30):
        p = logistic(design @ state)
        slope = design.T @ ((p - smooth) * weight) + 1e-3 * state
        curvature = (design * (p * (1 - p) * weight)[:, None]).T @ design + 1e-3 * np.eye(2)
        state = state - np.clip(np.linalg.solve(curvature, slope), -2, 2)
    return model._replace(slope=float(state[0]) / spread, shift=float(state[1]))


def cut_of(odds: np.ndarray, target: np.ndarray) -> float:
    """Between the classes where they part best, yet not above nearly all good documents."""
    good = np.sort(odds[target > 0.5])
    values = np.unique(odds)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    bad = np.sort(odds[target <= 0.5])
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    dropped = np.searchsorted(bad, cuts) / len(bad)
    allowed = kept >= KEEP_GOOD
    return float(cuts[np.argmax(np.where(allowed, kept + dropped, -1))])


# Passes over the whole table's features.


def _summed(rows: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """Vectors of whole numbers by view and label, added up within each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for view, label, vector in per_batch(batch):
                key = (view, label)
                totals[key] = totals[key] + vector if key in totals else vector
        for (view, label), vector in totals.items():
            at = vector.nonzero()[0]
            same = [np.full(len(at), value, np.int64) for value in (view, label)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(at), pa.array(vector[at])], names=COUNTS.names)

    sums = rows.mapInArrow(run, COUNTS).groupBy("view", "label", "place").agg(F.sum("n").alias("n")).toPandas()
    found = {}
    for key, part in sums.groupby(["view", "label"]):
        vector = np.zeros(int(part["place"].max()) + 1, np.int64)
        vector[part["place"].to_numpy()] = part["n"].to_numpy()
        found[key] = vector
    return found


def _bin(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(odds / BIN).astype(np.int64) + BINS, 0, 2 * BINS - 1)


def limits(pool: DataFrame, models: list[Linear], share: float) -> list[tuple[int, int]]:
    """Per view the highest bin that may teach 0 and the lowest that may teach 1: confident ones, of these
    so many of the outermost bins as the share of the table needs. A view that is not sure of both
    kinds teaches nothing, as examples of one kind alone would only shift the other view."""

    def counted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for view, rows in enumerate(views_of(_columns(batch))):
            yield view, 0, np.bincount(_bin(models[view].odds(rows)), minlength=2 * BINS)

    found = _summed(pool, counted)
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    low, high = int(_bin(np.array([-sure]))[0]), int(_bin(np.array([sure]))[0])
    edges = []
    for view in range(len(VIEWS)):
        counts = np.zeros(2 * BINS, np.int64)
        own = found.get((view, 0), counts)
        counts[: len(own)] = own
        quota = max(1, int(share * counts.sum()))
        up, down = np.cumsum(counts), np.cumsum(counts[::-1])
        last, first = min(low - 1, int(np.searchsorted(up, quota))), max(high + 1, 2 * BINS - 1 - int(np.searchsorted(down, quota)))
        both = counts[: last + 1].any() and counts[first:].any()
        edges.append((last, first) if both else (-1, 2 * BINS))
    return edges


def teacher(models: list[Linear], edges: list[tuple[int, int]]) -> Step:
    """Documents of which one of the views is sure enough, with what each view is taught (-1: nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for view, rows in enumerate(views_of(_columns(batch))):
                bins = _bin(models[view].odds(rows))
                said.append(np.where(bins <= edges[view][0], 0, np.where(bins >= edges[view][1], 1, -1)))
            fresh = {field.name: pa.array(said[1 - view], pa.int32()) for view, field in enumerate(TAUGHT)}
            yield with_columns(batch, fresh).filter(pa.array((said[0] >= 0) | (said[1] >= 0)))

    return run


def gradients(lessons: DataFrame) -> Taught:
    """Gradients over all taught documents, at weights still to come."""

    def at(weights: list[np.ndarray]) -> list[Gradient]:
        def summed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
            for view, rows in enumerate(views_of(_columns(batch))):
                target = batch.column(TAUGHT[view].name).to_numpy()
                mine = target >= 0
                for label, (n, loss, sums) in gradient(weights[view], some(rows, mine), target[mine], PLACES[view]).items():
                    yield view, label, np.concatenate([[n, loss], sums])

        found = _summed(lessons, summed)
        results: list[Gradient] = [{} for _ in VIEWS]
        for (view, label), vector in found.items():
            full = np.zeros(2 + PLACES[view], np.int64)
            full[: len(vector)] = vector
            results[view][label] = (int(full[0]), int(full[1]), full[2:])
        return results

    return at


def _sample(labels: DataFrame, most: int, label_column: str) -> tuple[DataFrame, dict[float, int]]:
    """The ids to learn from, those with the smallest hashes of each class, and the classes' sizes."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_column).isNotNull())
    known = known.groupBy("doc_id").agg((F.max(label_column) > 0).cast("double").alias("label"))
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label in (0.0, 1.0)]
    return parts[0].unionByName(parts[1]), sizes


def train(
    docs: DataFrame,
    labels: DataFrame,
    labelled: int = LABELLED,
    rounds: int = ROUNDS,
    label_column: str = "quality",
) -> Model | None:
    """A model from the labels and the whole table; None if the sample lacks one of the two classes."""
    with Staging(docs.sparkSession) as staging:
        ids, sizes = _sample(labels, labelled, label_column)
        ids = F.broadcast(staging.put(ids, "sample"))
        if len(sizes) < 2:
            return None
        rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
        features = staging.put(mapped(rows, [featurer], FEATURES, keep=["doc_id"]), "features")
        names = [field.name for field in FEATURES]
        one_each = features.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*names)).alias("row"))
        known = one_each.select("doc_id", "label", "row.*").toPandas().sort_values("doc_id")
        target = known["label"].to_numpy(float)
        if len(set(target.tolist())) < 2:
            return None
        return cotrain(
            views_of({name: list(known[name]) for name in names}),
            target,
            np.where(target > 0.5, sizes[1.0] / target.sum(), sizes[0.0] / (len(target) - target.sum())),
            features.join(ids, "doc_id", "left_anti"),
            rounds,
            staging,
        )


def cotrain(views: list[Rows], target: np.ndarray, weight: np.ndarray, pool: DataFrame, rounds: int, staging: Staging) -> Model:
    """Rounds of teaching between the views; `weight` undoes the drawing of labels by class."""
    held = np.zeros(len(target), bool)
    for label in (0.0, 1.0):
        own = np.flatnonzero(target == label)
        held[own[4::5]] = True
    if len(set(target[held].tolist())) < 2:
        held[:] = False
    judged = held if held.any() else ~held
    weight = weight / weight[judged].mean()
    inside, outside = [some(view, ~held) for view in views], [some(view, judged) for view in views]

    def judged_models(trained: list[np.ndarray]) -> list[Linear]:
        return [calibrated(rounded(w), rows, target[judged], weight[judged]) for w, rows in zip(trained, outside, strict=True)]

    trained = train_views(inside, target[~held], [np.zeros(places) for places in PLACES], STEPS, None)
    for done in range(rounds):
        models = judged_models(trained)
        edges = limits(pool, models, SHARE * (done + 1))
        lessons = staging.put(mapped(pool, [teacher(models, edges)], TAUGHT, keep=[f.name for f in FEATURES]), f"taught{done}")
        trained = train_views(inside, target[~held], trained, ROUND_STEPS, gradients(lessons))
    models = judged_models(trained)
    good = float((weight * (target > 0.5))[judged].sum())
    prior = float(np.log(good / (weight[judged].sum() - good)))
    model = Model(*models, prior=prior, cut=0.0)
    return model._replace(cut=cut_of(model.odds(*outside)[2], target[judged]))


def scorer(model: Model | None) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                none = pa.nulls(n, pa.float64())
                new = {"content_score": none, "metadata_score": none, "score": none, "keep": pa.array([True] * n, pa.bool_())}
            else:
                one, two, both = model.odds(*views_of(featured(batch)))
                new = {
                    "content_score": pa.array(logistic(one)),
                    "metadata_score": pa.array(logistic(two)),
                    "score": pa.array(logistic(both)),
                    "keep": pa.array(both >= model.cut),
                }
            yield with_columns(batch, new)

    return run


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """`docs` (lang, source, n_chars, text) with both views' scores, `score` and `keep`."""
    return mapped(docs, [scorer(model)], SCORES, keep)
