"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsmill.llm.common import pick
from newsmill.session import durable

PREFIXES = (3, 4, 5, 6, 8)
GRAMS = (4, 6)  # at all positions of runs above LONG bytes
LONG = 8
SLACK = 1.05


def _letters() -> np.ndarray:
    """Bytes as word letters: A-Z lower-cased, digits, the bytes of non-ASCII characters;
    0 for what parts words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    t[~keep] = 0
    return t


def text_buffers(texts, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of stretches of an Arrow string column; about ``size`` bytes
    each, or one text.  Null texts are empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words: 64-bit hashes of the first 3, 4, 5, 6 and 8 bytes of each
    word, and of each word as a whole.  Words of more than 8 bytes (compounds, or text without
    ASCII blanks) also have the grams of 4 and 6 bytes at all their positions; a gram is the
    same feature as a word's beginning of that size."""
    x = _letters()[data]
    inside = x > 0
    before = np.concatenate(([False], inside[:-1]))
    before[offsets[:-1][offsets[:-1] < len(x)]] = False
    starts = np.flatnonzero(inside & ~before)
    row = np.searchsorted(offsets, starts, "right") - 1
    room = offsets[row + 1] - starts
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    alive = np.ones(len(starts), bool)
    rows, found = [], []
    for j in range(9):
        c = np.where(j < room, x[np.minimum(starts + j, max(len(x) - 1, 0))], 0)
        ended = alive & (c == 0)
        rows.append(row[ended])
        found.append((h[ended] ^ np.uint64(0xFF51)) * np.uint64(0x9E3779B97F4A7C15))
        alive &= c > 0
        h = np.where(alive, (h ^ c.astype(np.uint64)) * np.uint64(0x100000001B3), h)
        h ^= h >> np.uint64(29)
        if j + 1 in PREFIXES:
            rows.append(row[alive])
            found.append(h[alive] * np.uint64(0x9E3779B97F4A7C15))
    after = np.concatenate((inside[1:] & ~_first(starts, len(x))[1:], [False])) if len(x) else inside
    ends = np.flatnonzero(inside & ~after) + 1
    long = ends - starts > LONG
    starts, sizes, row = starts[long], (ends - starts)[long], row[long]
    if len(starts):
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(sizes.sum()) - np.repeat(first, sizes)
        at, left, row_at = np.repeat(starts, sizes) + place, np.repeat(sizes, sizes) - place, np.repeat(row, sizes)
        power = np.cumprod(np.full(sizes.max(), 0xD6E8FEB86659FD93, np.uint64))
        whole = np.add.reduceat((x[at].astype(np.uint64) + np.uint64(1)) * power[place], first)
        rows.append(row)
        found.append((whole ^ (whole >> np.uint64(29)) ^ np.uint64(0xC4CE)) * np.uint64(0x9E3779B97F4A7C15))
        within = place > 0  # the first has been counted as the word's beginning
        at, left, row_at = at[within], left[within], row_at[within]
        h = np.full(len(at), 0xCBF29CE484222325, np.uint64)
        for j in range(max(GRAMS)):
            fits = left > j
            at, left, row_at, h = at[fits], left[fits], row_at[fits], h[fits]
            h = (h ^ x[at + j].astype(np.uint64)) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            if j + 1 in GRAMS:
                rows.append(row_at)
                found.append(h * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(rows), np.concatenate(found)


def _first(starts: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[starts] = True
    return out


@dataclass
class Model:
    """A sparse linear classifier over the presence of features; ``vocabulary`` is sorted."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    seen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def known(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, place in the vocabulary)."""
        if not len(self.vocabulary):
            return rows[:0], rows[:0]
        maybe = self.seen[(hashes >> np.uint64(44)).astype(np.int64)]
        rows, hashes = rows[maybe], hashes[maybe]
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == hashes
        both = np.unique(rows[hit] * np.int64(len(self.vocabulary)) + place[hit])
        return np.divmod(both, len(self.vocabulary))

    def scores(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, data, offsets in text_buffers(texts):
            rows, place = self.known(*features(data, offsets))
            out[first : first + len(offsets) - 1] += np.bincount(
                rows, self.weights[place], minlength=len(offsets) - 1
            )
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_nnpu(
    rows: np.ndarray,
    places: np.ndarray,
    positive: np.ndarray,
    size: int,
    prior: float,
    steps: int = 400,
    rate: float = 0.05,
    l2: float = 1e-4,
    capped: bool = True,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss:

        prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

    ``rows`` and ``places`` are the ones of a 0/1 matrix, ``positive`` marks its confirmed
    rows; all others are unlabelled.  Where the second term goes below zero, the step climbs
    out of it instead (the estimator's correction against overfitting).  If ``capped``, the
    bias is lowered in the end, if need be, until no more than ``SLACK * prior`` of the
    unlabelled rows score 0.5 or more.
    """
    w, b = np.zeros(size), -2.0
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        g = b + np.bincount(rows, w[places], minlength=len(positive))
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_neg = np.logaddexp(0, g)
        negative_risk = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
        of_negatives = np.where(positive, -prior * p / n_p, p / n_u)
        if negative_risk >= 0:
            slope = of_negatives + np.where(positive, -prior * (1 - p) / n_p, 0)
        else:
            slope = -of_negatives
        dw = np.bincount(places, slope[rows], minlength=size) + l2 * w
        db = slope.sum()
        m, v = 0.9 * m + 0.1 * dw, 0.999 * v + 0.001 * dw * dw
        mb, vb = 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db * db
        scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        b -= scale * mb / (np.sqrt(vb) + 1e-8)
    if not capped:
        return w, b
    g = b + np.bincount(rows, w[places], minlength=len(positive))
    most = np.quantile(g[~positive], max(0.0, 1 - SLACK * prior)) if (~positive).any() else -1.0
    return w, b - (most + 1e-6 if most >= 0 else 0.0)


def threshold(toxic: np.ndarray, clean: np.ndarray) -> float | None:
    """The cut between two sets of margins with the least sum of the shares on the wrong side,
    in the widest gap where several are as good.  It does not depend on how many there are of
    either.  None where no cut tells them apart."""
    values = np.unique(np.concatenate((toxic, clean)))
    if len(values) < 2 or not len(toxic) or not len(clean):
        return None
    cuts = (values[1:] + values[:-1]) / 2
    wrong = np.searchsorted(np.sort(toxic), cuts) / len(toxic)
    wrong += 1 - np.searchsorted(np.sort(clean), cuts) / len(clean)
    best = wrong.min()
    if best >= 1:
        return None
    return float(max((gap, cut) for gap, cut, w in zip(np.diff(values), cuts, wrong) if w <= best + 1e-12)[1])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves no remainder.  Without an id: true."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    most_positive: int = 4000,
    most_unlabelled: int = 12000,
    vocabulary: int = 4096,
    least_positive: int = 6,
    least_lift: float = 2.5,
    least_z: float = 4.0,
) -> Model:
    """A model from confirmed toxic texts (label 1) and unlabelled ones.

    The fit uses a sample bounded by ``most_positive`` and ``most_unlabelled`` rows, the ones
    with the least hashes of their ids, never held-out ones.  An id that stands on several rows
    gives one of its texts, that of the least hash.  Whether an unlabelled row is
    toxic is not looked at.  The prior is the share of 1 among the labels not held out, unless
    given.  The vocabulary is up to ``vocabulary`` features that the confirmed texts have more
    often than the unlabelled ones: in at least ``least_positive`` texts, ``least_lift`` times as
    often, and by ``least_z`` standard deviations.  A score of 0.5 is where labelled rows, not
    held out, of label 1 and of label 0 (up to ``most_positive`` of each) part best, so how many
    documents may be toxic is not bounded by the share among the labels; without a row of label
    0 it is the fit's own.  Null texts, ids and labels are not learnt
    from.  Without a confirmed text every text scores the prior.
    """
    texts = pick(df, doc_id=id_col, text=text_col).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    marks = pick(labels, doc_id=id_col, label=label_col).where(
        ~held_out(F.col("doc_id")) & F.col("label").isNotNull()
    )
    if prior is None:
        prior = marks.agg(F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    order = F.xxhash64(F.lit("sample"), "doc_id")
    confirmed = marks.where("label = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_positive)
    free = texts.select("doc_id").distinct().orderBy(order, "doc_id").limit(most_unlabelled)
    chosen = confirmed.select("doc_id", F.lit(True).alias("positive")).unionByName(
        free.select("doc_id", F.lit(False).alias("positive"))
    )
    # at most most_positive + most_unlabelled ids, and a row each however often an id stands
    sample = durable(
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "positive")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("positive", "text"),
        "sample",
    )

    def grams(batches: Iterator) -> Iterator:
        for batch in batches:
            positive = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_buffers(batch.column(1)):
                rows, hashes = features(data, offsets)
                n = len(offsets) - 1
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                rows, hashes = rows[new], hashes[new]
                ends = np.searchsorted(rows, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.record_batch([pa.array(positive[first : first + n], pa.bool_()), lists], ["positive", "grams"])

    counted = sample.mapInArrow(grams, "positive boolean, grams array<long>").select(
        "positive", F.explode("grams").alias("gram")
    )
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_p or not n_u:
        odds = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(odds / (1 - odds))), prior)
    expected = F.col("u") * (n_p / n_u)  # in the confirmed texts, were they like the unlabelled
    z = (F.col("p") - expected) / F.sqrt(expected + 1)
    best = (
        counted.groupBy("gram")
        .agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
        .where((F.col("p") >= least_positive) & (F.col("p") >= least_lift * expected) & (z >= least_z))
        .orderBy(z.desc(), "gram")
        .limit(vocabulary)
        .select("gram")
        .collect()
    )
    words = np.sort(np.array([r.gram for r in best], np.int64).view(np.uint64))
    model = Model(words, np.zeros(len(words)), 0.0, prior)

    def places(batches: Iterator) -> Iterator:
        for batch in batches:
            positive = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_buffers(batch.column(1)):
                rows, place = model.known(*features(data, offsets))
                n = len(offsets) - 1
                ends = np.searchsorted(rows, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
                yield pa.record_batch([pa.array(positive[first : first + n], pa.bool_()), lists], ["positive", "places"])

    kept = sample.mapInArrow(places, "positive boolean, places array<int>").toArrow()
    lists = kept.column("places").combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().to_numpy(), np.int64))
    at = lists.flatten().to_numpy().astype(np.int64)
    positive = kept.column("positive").to_numpy().astype(bool)
    weights, bias = fit_nnpu(rows, at, positive, len(words), prior, capped=False)
    safe = marks.where("label = 0").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_positive)
    score = toxicity(Model(words, weights, bias, prior))
    bodies = texts.join(F.broadcast(safe), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    clean = bodies.select(score("text").alias("score")).toArrow()
    clean = clean.column("score").to_numpy()
    toxic = np.clip(bias + np.bincount(rows, weights[at], minlength=len(positive)), -30, 30)[positive]
    cut = threshold(toxic, np.log(clean) - np.log1p(-clean))
    bias -= cut or 0.0
    return Model(words, weights, bias, prior)


def toxicity(model: Model):
    """A function of a text column: the score, 0 to 1, of each whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return score


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null, empty and wordless texts get the score of the bias alone.  No shuffle.
    """
    return (
        pick(df, doc_id=id_col, text=text_col)
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(model)("text").alias("score"))
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    )
