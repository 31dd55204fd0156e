"""Toxicity by two class-conditional Kneser-Ney models over characters, with shared backoff counts.

Each class has an interpolated model of six-byte windows: occurrences at the highest order, continuation
counts below. Under its lowest order lies one Kneser-Ney model of continuation counts over the whole
corpus, kept as a table by n-gram that grows with it. Both classes share that model: where neither has
seen an n-gram it is the same factor in both and leaves the ratio, so the ratios need its rows at the
sample's n-grams only, and those are joined to it.

A toxic document is mostly ordinary words: under its model each word is toxic with probability ``MIXED``
and ordinary otherwise. A text's score compares that likelihood with the ordinary one over its different
words, length-normalised, and is calibrated on labelled texts that the counts behind it have not seen. The classes'
discount and the share of toxic words are those that order such texts best, so nothing is set by texts outside
the training fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import broadcast, pieces, scope, stored, text_column, tidy, trim
from framewright.llm.language import fold, symbols
from framewright.llm.words import Probed, Table, hashes_between, lowered

#: Bytes of the longest window, and of the shortest one that the classes count for themselves.
ORDER, LOWEST = 6, 4
#: Discounts of the corpus model and of the classes; of a count below the discount nothing is left.
SHARED_DISCOUNT, DISCOUNT = 0.9, 1.5
#: Share of the words of a toxic document that its class's model makes, the rest are ordinary.
MIXED = 0.01
#: What the cross-validation chooses from.
DISCOUNTS, MIXES = (0.75, 1.5, 2.5), (0.003, 0.01, 0.03)
#: Texts that each step of the calibration counts besides its own, half of them toxic.
PSEUDO = 8.0
#: Parts of the labelled sample; each is scored by counts of the others for the calibration.
PARTS = 4
#: Bytes of text whose windows are held at a time.
PIECE = 1 << 18


@dataclass
class Model:
    """Log ratios by window, and the calibration of a text's features."""

    windows: dict[int, tuple[np.ndarray, np.ndarray]]  # order -> (sorted windows, log ratios)
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]  # order -> (sorted contexts, log ratios of their backoff weights)
    weights: tuple[float, ...] = (0.0, 0.0)
    steps: tuple[np.ndarray, np.ndarray] | None = None
    mixed: float = MIXED


def streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each behind a space and followed by one, and the end of each text in there."""
    data, ends = lowered(texts)
    parts, at = [], 0
    for end in ends.tolist():
        own = symbols(data[at:end])
        parts.append(np.concatenate([[32], own, [32]]).astype(np.uint8))
        at = end + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.cumsum([len(p) for p in parts]).astype("i8")


def suffix(window: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of packed windows."""
    return window & np.uint64((1 << 8 * order) - 1)


def windows_of(stream: np.ndarray, ends: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The last ``order`` bytes at each position, packed into one integer; spaces stand before a text's start."""
    out = np.zeros(len(stream), "u8")
    padded = np.concatenate([np.full(order - 1, 32, np.uint8), stream])
    for k in range(order):
        out = (out << np.uint64(8)) | padded[k : k + len(stream)].astype("u8")
    blank = int.from_bytes(b" " * order)
    start = np.concatenate([[0], ends[:-1]])[: len(ends)]
    for k in range(order - 1):
        at = (start + k)[start + k < ends]
        own = (1 << 8 * (k + 1)) - 1
        out[at] = (out[at] & np.uint64(own)) | np.uint64(blank & ~own)
    return out


class Scorer:
    """Log ratios of whole batches: a window's own, or its context's backoff weights and what the next order says."""

    def __init__(self, model: Model):
        self.weights, self.steps, self.mixed = model.weights, model.steps, model.mixed
        self.windows = {order: Probed(*table) for order, table in model.windows.items()}
        self.contexts = {order: Probed(*table) for order, table in model.contexts.items()}

    def ratios(self, stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log ratio of each byte given those before it in its text."""
        window = windows_of(stream, ends)
        out, hit = self.windows[ORDER](window)
        open_at = np.flatnonzero(~hit)
        for order in range(ORDER, LOWEST - 1, -1):
            w = suffix(window[open_at], order)
            if order < ORDER:
                value, hit = self.windows[order](w)
                out[open_at] += value
                open_at, w = open_at[~hit], w[~hit]
            out[open_at] += self.contexts[order](w >> np.uint64(8))[0]
        return out

    def features(self, texts: pa.Array, mixes: tuple[float, ...] | None = None) -> np.ndarray:
        """texts x mixes: mean log ratio of each text's different words, with the given shares of toxic words.

        The ratio is of a toxic document's likelihood to an ordinary one's. A word counts where it first
        stands, so that a text that repeats itself is no more than what it repeats. Nothing of a text
        depends on its neighbours: windows, sums and words end at its borders.
        """
        mixes = mixes or (self.mixed,)
        stream, ends = streams(texts)
        if not len(stream):
            return np.zeros((len(ends), len(mixes)))
        ratio = self.ratios(stream, ends)
        stop, start, owner = words_in(stream, ends)
        name = hashes_between(stream, start, stop)
        order = np.lexsort((start, name, owner))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (owner[order][1:] != owner[order][:-1])])[: len(order)]
        first = np.sort(order[new])  # back in the order of the text
        word = np.add.reduceat(np.append(ratio, 0.0), np.stack([start, stop + 1], 1).ravel())[::2] if len(start) else np.zeros(0)
        word = np.expm1(np.minimum(word[first], 30.0))
        number = np.maximum(np.bincount(owner[first], minlength=len(ends)), 1)
        return np.stack([np.bincount(owner[first], weights=np.log1p(m * word), minlength=len(ends)) / number for m in mixes], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probability; a hundredth of it is the plain logistic, which orders equal steps."""
        x = linear(self.features(texts), self.weights)
        plain = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        return plain if self.steps is None else 0.99 * np.interp(x, *self.steps) + 0.01 * plain


def words_in(stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the space behind it, its first byte, and its text."""
    space = stream == 32
    before = np.concatenate([[True], space[:-1]])
    stop, start = np.flatnonzero(space & ~before), np.flatnonzero(~space & before)
    return stop, start, np.searchsorted(ends, stop, side="right")


def linear(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Weighted sum of each row, in the same order for any number of rows."""
    out = np.full(len(x), weights[0])
    for k, w in enumerate(weights[1:]):
        out = out + x[:, k] * w
    return out


def window_counts(sample: DataFrame) -> DataFrame:
    """(w, c0, c1, ...): occurrences of each window in each part of the sample's ordinary texts, then of its toxic ones."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                cell = piece.column("toxic").to_numpy(zero_copy_only=False) * PARTS + piece.column("part").to_numpy(zero_copy_only=False)
                stream, ends = streams(piece.column("text"))
                key, inverse = np.unique(windows_of(stream, ends), return_inverse=True)
                whose = np.repeat(cell, np.diff(ends, prepend=0))
                n = [np.bincount(inverse[whose == c], minlength=len(key)).astype("i8") for c in range(2 * PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), *map(pa.array, n)], names=["w", *(f"c{c}" for c in range(2 * PARTS))])

    names = [f"c{c}" for c in range(2 * PARTS)]
    found = sample.mapInArrow(tidy(run, True), ", ".join(["w long", *(f"{c} long" for c in names)]))
    return found.groupBy("w").agg(*(F.sum(c).cast("int").alias(c) for c in names))  # of a bounded sample


def corpus_table(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(g, n): for each n-gram of LOWEST bytes of all texts, the number of different bytes in front of it.

    Tasks send their distinct windows, ``most`` of them at a time; the table grows with the corpus.
    """

    def run(batches):
        parts, total = [], 0
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                stream, ends = streams(part.column("text"))
                parts.append(np.unique(windows_of(stream, ends, LOWEST + 1)))
                total += len(parts[-1])
                if total > most:
                    parts = [np.unique(np.concatenate(parts))]
                    total = len(parts[0])
                    if 2 * total > most:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0].view("i8"))], names=["w"])
                        parts, total = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)).view("i8"))], names=["w"])

    windows = docs.select(text_column().alias("text")).mapInArrow(tidy(run, True), "w long").distinct()
    return windows.groupBy(F.col("w").bitwiseAND(F.lit((1 << 8 * LOWEST) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("n"))


def shared_rows(table: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (k, key, n, kinds) of the shared model that ``windows(w)`` need: n-grams of k bytes, and contexts of those as -k."""
    own = lambda k: F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
    front = lambda k: F.shiftright("g", 8 * k).bitwiseAND(F.lit(255)) if k < LOWEST else F.lit(None).cast("long")
    whole = lambda k: F.col("n") if k == LOWEST else F.lit(None).cast("long")
    each = [F.struct(F.lit(k).alias("k"), own(k).alias("key"), front(k).alias("front"), whole(k).alias("whole")) for k in range(1, LOWEST + 1)]
    count = F.coalesce(F.max("whole"), F.size(F.collect_set("front")).cast("long"))  # at most 256 different bytes
    grams = table.select(F.explode(F.array(*each)).alias("_s")).select("_s.*").groupBy("k", "key").agg(count.alias("n"))
    contexts = grams.groupBy((-F.col("k")).alias("k"), F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    low = windows.select(F.col("w").bitwiseAND(F.lit((1 << 8 * LOWEST) - 1)).alias("w")).distinct()
    need = [F.struct(F.lit(s * k).alias("k"), F.shiftright(F.col("w").bitwiseAND(F.lit((1 << 8 * k) - 1)), 8 * (s < 0)).alias("key")) for k in range(1, LOWEST + 1) for s in (1, -1)]
    wanted = low.select(F.explode(F.array(*need)).alias("_s")).select("_s.*").distinct()
    return grams.withColumn("kinds", F.lit(0).cast("long")).unionByName(contexts).join(wanted, ["k", "key"], "left_semi")


class Shared:
    """The corpus model of LOWEST bytes at the n-grams asked for: interpolated Kneser-Ney over continuation counts."""

    def __init__(self, k: np.ndarray, key: np.ndarray, n: np.ndarray, kinds: np.ndarray):
        at = {j: k == j for o in range(1, LOWEST + 1) for j in (o, -o)}
        key = key.astype("u8")
        self.number = {j: Table(key[i], n[i].astype("f8"), 0.0) for j, i in at.items()}
        self.kinds = {j: Table(key[i], kinds[i].astype("f8"), 0.0) for j, i in at.items() if j < 0}

    def __call__(self, window: np.ndarray) -> np.ndarray:
        """Probability of each window's last byte after those before it."""
        p = np.full(len(window), 1 / 256)
        for k in range(1, LOWEST + 1):
            gram = suffix(window, k)
            n, total, kinds = self.number[k](gram)[0], self.number[-k](gram >> np.uint64(8))[0], self.kinds[-k](gram >> np.uint64(8))[0]
            p = np.where(total > 0, (np.maximum(n - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * kinds * p) / np.maximum(total, 1), p)
        return p


def class_models(window: np.ndarray, counts: np.ndarray, shared, discount: float = DISCOUNT) -> dict[int, tuple[np.ndarray, ...]]:
    """Per order: sorted windows, both classes' probabilities of the last byte, contexts, and their backoff weights.

    ``counts`` (2 x windows) are occurrences at the highest order; lower orders count the different bytes in
    front. ``shared`` gives the probabilities below the classes' lowest order.
    """
    grams, number = {ORDER: (window, counts.astype("f8"))}, counts
    for order in range(ORDER - 1, LOWEST - 1, -1):
        above, number = grams[order + 1]
        low, inverse = np.unique(suffix(above, order), return_inverse=True)
        grams[order] = (low, np.stack([np.bincount(inverse, weights=(number[c] > 0).astype("f8"), minlength=len(low)) for c in (0, 1)]))
    out, below = {}, None
    for order in range(LOWEST, ORDER + 1):
        key, number = grams[order]
        context, inverse = np.unique(key >> np.uint64(8), return_inverse=True)
        total = np.stack([np.bincount(inverse, weights=number[c], minlength=len(context)) for c in (0, 1)])
        taken = np.stack([np.bincount(inverse, weights=np.minimum(number[c], discount), minlength=len(context)) for c in (0, 1)])
        lower = np.broadcast_to(shared(key), number.shape) if below is None else below[1][:, np.searchsorted(below[0], suffix(key, order - 1))]
        left = np.where(total > 0, taken / np.maximum(total, 1), 1.0)  # a context that a class lacks leaves all to the next order
        p = np.maximum(number - discount, 0) / np.maximum(total, 1)[:, inverse] + left[:, inverse] * lower
        below = (key, p)
        out[order] = (key, p, context, left)
    return out


def train(window: np.ndarray, counts: np.ndarray, shared, discount: float = DISCOUNT) -> Model:
    """Log ratios of all windows and of all contexts' backoff weights by order, from class counts (2 x windows) and ``shared``."""
    levels = class_models(window, counts, shared, discount)
    return Model({k: (key, np.log(p[1] / p[0])) for k, (key, p, _, _) in levels.items()}, {k: (context, np.log(left[1] / left[0])) for k, (_, _, context, left) in levels.items()})


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pseudo: float = 0.0, prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression (pool adjacent violators): both ends and the means of the pooled blocks.

    Each block counts ``pseudo`` more texts of its mean weight, of which ``prior`` are toxic, so that a block of
    few texts is not sure of itself.
    """
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([weight[i], weight[i] * y[i], x[i], x[i], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3], blocks[-1][4] + last[4]]
    w, wy, low, high, n = np.array(blocks).T
    more = pseudo * w / n
    return np.stack([low, high], 1).ravel(), np.maximum.accumulate((wy + prior * more) / (w + more)).repeat(2)


def calibrated(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-5) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, with the classes weighted to ``prior``."""
    if len(y) == 0 or y.min() == y.max():
        return (float(np.log(prior / (1 - prior))), *([0.0] * x.shape[1]))
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) / len(y)
    w = np.zeros(z.shape[1])
    keep = np.diag([1e-9, *[ridge] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + keep, z.T @ (share * (y - p)) - keep @ w)
        w += step * min(1.0, 5 / np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    return (float(w[0]), *(float(a) for a in w[1:] / scale))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, prior: float) -> None:
    """Set the model's calibration from held-out features and labels."""
    model.weights = calibrated(x, y, prior)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model.steps = monotone(linear(x, model.weights), y, weight, PSEUDO, prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(toxic, part, text) of at most ``per_class`` labelled documents of each class.

    Labels of ids without a document are left out first. Those with the least hash of the id are taken, all of a class that has no more; they fall into
    ``PARTS`` parts by another hash, and copies of a text teach once. Contradicting labels of one id, and
    null labels, teach nothing.
    """
    one = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_top")).where("toxic = _top").drop("_top")
    one = one.join(docs.select("doc_id"), "doc_id", "left_semi")
    first = [one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]  # the best of each task's best
    chosen = first[0].unionByName(first[1]).select("doc_id", "toxic")  # at most 2 * per_class rows
    picked = docs.select("doc_id", text_column().alias("text")).join(F.broadcast(chosen), "doc_id")
    once = picked.groupBy("toxic", F.xxhash64("text").alias("_h")).agg(F.min(F.struct("doc_id", "text")).alias("_d")).select("toxic", "_d.*")
    return once.select("toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PARTS)).cast("int").alias("part"), "text")


def with_features(docs: DataFrame, model: Model) -> DataFrame:
    """(toxic, f): label and features of each of ``docs(toxic, text)``, one for each of MIXES."""
    shared = broadcast(docs.sparkSession, model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                x = scorer.features(part.column("text"), MIXES)
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(MIXES)).cast(pa.list_(pa.float64()))], names=["toxic", "f"])

    return docs.select("toxic", "text").mapInArrow(tidy(run, True), "toxic int, f array<double>")


def ordered_share(x: np.ndarray, y: np.ndarray) -> float:
    """Share of the pairs of a toxic and an ordinary text that x orders rightly, ties half (the area under the ROC curve)."""
    values, at, number = np.unique(x, return_inverse=True, return_counts=True)
    rank = np.cumsum(number) - (number - 1) / 2
    toxic = y.sum()
    return float((rank[at][y == 1].sum() - toxic * (toxic + 1) / 2) / max(toxic * (len(y) - toxic), 1))


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame, per_class: int = 5000) -> Model:
    """Learn from ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; ``corpus`` has all texts.

    The classifier sees at most ``per_class`` labelled documents of each class; the shared backoff model
    counts every text of ``corpus``. Each part of the sample gets features from models of the other parts, one for
    each of DISCOUNTS and MIXES; the pair that orders the sample best (of equals the first) makes the
    calibration, and the scores come from its model of all parts. Both classes weigh alike in it, so
    a score is the share that the text's evidence gives to the toxic class. Where a class has no
    document every score is the share of toxic labels (0.5 without labels), within 0.01 and 0.99.
    """
    sample = stored(labelled_sample(docs, labels, per_class), "toxic-sample")
    counted = stored(window_counts(sample), "toxic-windows")
    table = stored(corpus_table(corpus), "corpus-ngrams")
    got = shared_rows(table, counted).toArrow()
    shared = Shared(*(got[c].to_numpy() for c in ("k", "key", "n", "kinds")))
    got = counted.toArrow()  # windows of at most 2 * per_class texts
    key = got["w"].to_numpy().view("u8")
    order = np.argsort(key)
    key, cells = key[order], [got[f"c{c}"].to_numpy()[order] for c in range(2 * PARTS)]
    del got

    def trained(left_out: int | None, discount: float) -> Model:
        counts = np.stack([sum(cells[c * PARTS + p] for p in range(PARTS) if p != left_out) for c in (0, 1)])
        some = counts.any(0)
        return train(key[some], counts[:, some], shared, discount)

    share = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    prior = min(max(share if share is not None else 0.5, 0.01), 0.99)
    best = None
    for discount in DISCOUNTS:
        held = []
        for p in range(PARTS):
            with scope():  # one model at a time is broadcast
                held.append(with_features(sample.where(F.col("part") == p), trained(p, discount)).toArrow())
        f = np.concatenate([np.array(h["f"].to_pylist(), "f8").reshape(-1, len(MIXES)) for h in held])
        y = np.concatenate([h["toxic"].to_numpy() for h in held]).astype("f8")
        for i, mixed in enumerate(MIXES):
            right = ordered_share(f[:, i], y)
            if best is None or right > best[0] + 1e-12:
                best = (right, discount, mixed, f[:, i : i + 1], y)
    _, discount, mixed, x, y = best
    model = trained(None, discount)
    model.mixed = mixed
    del key, cells
    trim()
    order = np.lexsort((y, *x.T))  # sums do not depend on how the rows were dealt
    calibrate(model, x[order], y[order], 0.5 if 0 < y.sum() < len(y) else prior)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the toxicity score of ``text`` as ``name``; a null text is an empty one."""
    shared = broadcast(docs.sparkSession, model)  # bounded by the labelled sample
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], text_column().alias("_text"))
    names = [*(f"c{i}" for i in range(len(keep))), "score"]
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "score double"])

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(scorer.scores(part.column("_text")))], names=names)

    return rows.mapInArrow(tidy(run, True), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold.

    Rows are scored each by its own whole text, however long; equal texts have equal scores. A null text is
    an empty one; a text without a word has no evidence and gets the score of mean ratio 0. Labels that
    are null, of no document, or contradict each other teach nothing; a null doc_id is in no label. An empty
    table has no rows; without labels every score is the same.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(fold(3) != 1).select("doc_id", "text"), labels.where(fold(3) != 1).select("doc_id", "toxic"), docs.select("text"))
    found = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
