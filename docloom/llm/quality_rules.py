"""Quality rules: base counts, and a calibrated n-gram classifier.

Words and characters are hashed as n-grams (words of order 1 and 2, code points
of order 2, 4 and 6) into BUCKETS buckets. A text's feature vector holds
the share of each bucket among its n-grams of a family, so its logit is a bias
plus the mean weight of its n-grams: scoring is a gather and a sum, in Arrow
batches. Logistic regression is fitted on labelled rows (quality 1 and not
toxic against quality 0), at most SAMPLE of each class and as many as have VALUES
vector values, in the order of a hash of doc_id; these bounds on training are the
only ones, scores cover whole texts. A third of each class is held out for Platt
scaling of the logit to a probability, and rows are kept from the fixed THRESHOLD on.

Toxic text is told by a few words of it, which a mean over a text drowns, so a
second classifier looks at which words stand in a text at all: naive Bayes, on
at most SAMPLE rows labelled toxic (of any quality) against the good ones, with
the log odds of the hashed words that stand in SEEN training texts or more and
whose share of texts differs between the classes by a chi-square of SPLIT or
more. Its logit is scaled likewise; p_good is the smaller of the two.

Null and empty texts have no words, fail the base rules and are not kept. Equal
texts get equal values. A classifier that lacks one of its classes among the labels
has no say; without both the verdict is the base rules' alone. Labels that are null, or repeat, count as they stand.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import groups, map_arrow, record_batch
from docloom.llm.textbytes import is_space, runs, word_hashes, word_spans

BUCKETS = 1 << 18
#: Bounds on training, for each class: labelled rows, and values of their vectors.
SAMPLE, VALUES = 1000, 4_000_000
THRESHOLD = 0.3
SEEN, SPLIT = 4, 15.0
CHAR_ORDERS = (2, 4, 6)
WORD_ORDERS = (1, 2)
FAMILIES = len(CHAR_ORDERS) + len(WORD_ORDERS)
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
SLICE = 1 << 19


def base_counts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    heads = (raw & 0xC0) != 0x80
    word_chars = int(np.count_nonzero(heads & ~is_space(raw)))
    n_symbols = int(np.count_nonzero(SYMBOLS[raw]))
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(" \t\n\v\f\r"):
                dup += line in seen
                seen.add(line)
    repeats = 0
    if len(hashes) > WINDOW:
        windows = runs(hashes, WINDOW)
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            found = np.flatnonzero(np.isin(windows, twice))
            change = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(change, found, 1)
            np.add.at(change, found + WINDOW, -1)
            repeats = int(np.count_nonzero(np.cumsum(change) > 0))
    return len(starts), word_chars, n_symbols, dup, repeats


def characters(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(points: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(family, buckets of the n-grams) of one text; long texts come in several parts of a family."""
    for family, order in enumerate(CHAR_ORDERS):
        for at in range(0, len(points), SLICE):
            part = points[at : at + SLICE + order - 1]
            n = len(part) - order + 1
            if n > 0:
                key = np.full(n, order, np.uint64)
                for k in range(order):
                    key *= np.uint64(0xD6E8FEB86659FD93)
                    key += part[k : k + n]
                key *= np.uint64(0x9E3779B97F4A7C15)
                yield family, (key >> np.uint64(46)).astype(np.int32)
    for family, order in enumerate(WORD_ORDERS, len(CHAR_ORDERS)):
        if len(hashes) >= order:
            yield family, (runs(hashes, order) >> np.uint64(46)).astype(np.int32)


def family_means(points: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> float:
    sums, counts = np.zeros(FAMILIES), np.zeros(FAMILIES)
    for family, of in buckets(points, hashes):
        sums[family] += weights.take(of).sum(dtype=np.float64)
        counts[family] += len(of)
    return float((sums / np.maximum(counts, 1)).sum())


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a text: buckets, and their shares summed over the families."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_spans(raw)
    parts: dict[int, list[np.ndarray]] = {}
    for family, of in buckets(characters(text), word_hashes(raw, starts, ends)):
        parts.setdefault(family, []).append(of)
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    of = [np.concatenate(p) for p in parts.values()]
    share = np.concatenate([np.full(len(p), 1 / len(p), np.float64) for p in of])
    index, place = np.unique(np.concatenate(of), return_inverse=True)
    return index.astype(np.int32), np.bincount(place, share).astype(np.float32)


class Classifier:
    """Weights, bias and Platt's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, points: np.ndarray, hashes: np.ndarray) -> float:
        z = self.slope * (family_means(points, hashes, self.weights) + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def present_words(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the words that stand in a text, each once."""
    return np.unique((hashes >> np.uint64(46)).astype(np.int32))


class Toxicity:
    """Log odds by bucket (most are 0), Platt's slope and offset."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def probability(self, hashes: np.ndarray) -> float:
        """Of not being toxic."""
        of = (hashes >> np.uint64(46)).astype(np.int32)
        z = self.weights.take(np.unique(of[self.weights.take(of) != 0])).sum(dtype=np.float64)
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40))))


def fit_toxicity(words: list[np.ndarray], good: np.ndarray) -> Toxicity | None:
    """Naive Bayes on two thirds of each class, then Platt scaling on the rest; None if no word tells the classes apart."""
    held = thirds(good)
    texts, n = [], []
    for c in (0, 1):
        own = np.flatnonzero(~held & (good == c))
        texts.append(np.bincount(np.concatenate([words[i] for i in own]), minlength=BUCKETS).astype(np.float64))
        n.append(len(own))
    share = (texts[0] + texts[1]) / (n[0] + n[1])
    split = (texts[0] / n[0] - texts[1] / n[1]) ** 2 / np.maximum(share * (1 - share) * (1 / n[0] + 1 / n[1]), 1e-12)
    odds = np.log((texts[1] + 0.5) / (n[1] + 1)) - np.log((texts[0] + 0.5) / (n[0] + 1))
    weights = np.where((split >= SPLIT) & (texts[0] + texts[1] >= SEEN), odds, 0).astype(np.float32)
    if not weights.any():
        return None
    z = np.array([float(weights.take(words[i]).sum(dtype=np.float64)) for i in np.flatnonzero(held)])
    return Toxicity(weights, *platt(z, good[held]))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 80, ridge: float = 1e-5) -> Classifier:
    """Full-batch gradient steps with momentum on the class-balanced loss, then Platt scaling on a third of each class."""
    held = thirds(good)
    train = np.flatnonzero(~held)
    index = np.concatenate([vectors[i][0] for i in train])
    value = np.concatenate([vectors[i][1] for i in train])
    row = np.repeat(np.arange(len(train), dtype=np.int32), [len(vectors[i][0]) for i in train])
    parts = [slice(at, at + SLICE) for at in range(0, len(index), SLICE)]
    y = good[train].astype(np.float64)
    balance = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum()))

    def margins(w: np.ndarray, bias: float) -> np.ndarray:
        return sum((np.bincount(row[p], w.take(index[p]) * value[p], len(train)) for p in parts), np.zeros(len(train))) + bias

    def by_bucket(of_row: np.ndarray) -> np.ndarray:
        return sum((np.bincount(index[p], value[p] * of_row.take(row[p]), BUCKETS) for p in parts), np.zeros(BUCKETS))

    step = 4.0 / np.sqrt(by_bucket(balance) + 1e-6)  # rare buckets move farther, as in diagonal preconditioning
    w, bias, speed, drift = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        miss = (1 / (1 + np.exp(-np.clip(margins(w, bias), -40, 40))) - y) * balance
        speed = 0.9 * speed - step * (by_bucket(miss) + ridge * w)
        drift = 0.9 * drift - 1.0 * miss.sum()
        w += speed
        bias += drift
    z = np.array([float(w.take(vectors[i][0]) @ vectors[i][1]) + bias for i in np.flatnonzero(held)])
    slope, offset = platt(z, good[held])
    return Classifier(w.astype(np.float32), bias, slope, offset)


def thirds(good: np.ndarray) -> np.ndarray:
    """Every third row of each class."""
    held = np.zeros(len(good), np.bool_)
    for c in (0, 1):
        held[np.flatnonzero(good == c)[::3]] = True
    return held


def platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels, by Newton steps with Platt's smoothed targets."""
    n_good, n_bad = int(good.sum()), int(len(good) - good.sum())
    if not n_good or not n_bad:
        return 1.0, 0.0
    target = np.where(good > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    weight = np.where(good > 0, 0.5 / n_good, 0.5 / n_bad) * len(good)
    spread = max(float(np.std(z)), 1e-9)
    x = z / spread
    a, b = 1.0, 0.0
    loss = lambda a, b: (weight * (np.logaddexp(0, a * x + b) - target * (a * x + b))).sum() + 5e-4 * a * a
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        ga, gb = (g * x).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum()
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db, now = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, loss(a, b)
        for _ in range(30):  # full Newton steps can run away on few rows
            if loss(a - da, b - db) <= now:
                a, b = a - da, b - db
                break
            da, db = da / 2, db / 2
    return float(max(a, 1e-3) / spread), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, values: int = VALUES) -> tuple[Classifier | None, Toxicity | None]:
    """The classifiers from labelled rows, at most `sample` of each class (good, bad and toxic) and as many as have `values` values in all; each None if one of its classes is missing. One task fits them: what it holds follows these bounds."""
    label = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(4))
    draw = lambda rows: label.where(rows).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    classes = [draw(rows).withColumn("class", F.lit(k)) for k, rows in enumerate(("good = 0", "good = 1", "toxic"))]
    chosen = classes[0].unionByName(classes[1]).unionByName(classes[2])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")  # chosen has 3 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            vectors = [features(t) for t in texts]
            raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
            words = [present_words(word_hashes(raw, *word_spans(raw))) for raw in raws]
            yield record_batch(
                {"doc_id": part.column(0), "class": part.column(1), "index": [v[0].tobytes() for v in vectors], "value": [v[1].tobytes() for v in vectors], "words": [w.tobytes() for w in words]},
                {"doc_id": pa.int64(), "class": pa.int32(), "index": pa.binary(), "value": pa.binary(), "words": pa.binary()},
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: list[list[tuple]] = [[], [], []]
        size = [0, 0, 0]
        for batch in batches:
            for i, c in enumerate(batch.column(1).to_pylist()):
                index, value, words = (batch.column(k)[i].as_py() for k in (2, 3, 4))
                size[c] += len(index if c < 2 else words) // 4
                if size[c] <= values and len(drawn[c]) < sample or not drawn[c]:
                    drawn[c].append((np.frombuffer(index, np.int32), np.frombuffer(value, np.float32), np.frombuffer(words, np.int32)) if c < 2 else (None, None, np.frombuffer(words, np.int32)))
        bad, fine, toxic = drawn
        quality = toxicity = None
        if bad and fine and len(bad) + len(fine) >= 6:
            quality = fit([v[:2] for v in bad + fine], np.repeat([0, 1], [len(bad), len(fine)]))
        if min(len(fine), len(toxic)) >= 3:
            toxicity = fit_toxicity([v[2] for v in toxic + fine], np.repeat([0, 1], [len(toxic), len(fine)]))
        yield record_batch({"model": [pickle.dumps((quality, toxicity))]}, {"model": pa.binary()})

    vectors = map_arrow(rows.select("doc_id", "class", "text"), run, "doc_id long, class int, index binary, value binary, words binary")
    together = vectors.repartition(1).sortWithinPartitions("class", order, "doc_id", F.xxhash64("index"))
    made = map_arrow(together, learn, "model binary").first()
    return pickle.loads(made["model"]) if made else (None, None)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """Per row doc_id, the base counts, base_failed, p_good and kept; with carry, all columns of docs as `row` instead of doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # 2 * BUCKETS float32 values at most
    n_words, word_chars, symbols, dup, repeat = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    types = {n_words: pa.int64(), word_chars: pa.int64(), symbols: pa.int64(), dup: pa.int64(), repeat: pa.int64(), "base_failed": pa.bool_(), "p_good": pa.float64(), "kept": pa.bool_()}
    first = "row" if carry else "doc_id"
    source = docs.select(F.struct("*").alias("row"), "text") if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, toxicity = sent.value
        for part, texts in groups(batches):
            rows = []
            raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
            starts, ends = word_spans(raw)
            hashes = word_hashes(raw, starts, ends)
            at = 0
            for text in texts:
                size = len(text) if text.isascii() else len(text.encode())
                own = raw[at : at + size]
                a, b = np.searchsorted(starts, (at, at + size))
                counts = base_counts(own, starts[a:b], ends[a:b], hashes[a:b], text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
                p = model.probability(characters(text), hashes[a:b]) if model is not None else 1.0
                if toxicity is not None:
                    p = min(p, toxicity.probability(hashes[a:b]))
                rows.append((*counts, failed, p, not failed and p >= threshold))
                at += size + 1
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[first, *types])

    rest = T._parse_datatype_string("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean")
    return map_arrow(source, run, T.StructType([source.schema[first], *rest]))
