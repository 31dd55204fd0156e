"""The toxicity model against a plain one with all counts in dictionaries."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

from framewright.llm import language, toxicity
from framewright.llm.toxicity import DISCOUNT, LOWEST, ORDER, PARTS, SHARED_DISCOUNT
from framewright.llm.words import Probed

CLEAN = ["the pen and the inn", "an inn then", "tea on the table é"]
TOXIC = ["the zugga and zugmo", "zugti then", "an old zugga, an old zugga, an old zugga"]
OTHER = ["the quick brown fox 7 zugpe", "日本 the inn", "xylophone zuggamo", ""]


def grams(text, order):
    own = b" " * ORDER + language.symbols(text.lower().encode()).tobytes() + b" "
    return [own[i - order + 1 : i + 1] for i in range(ORDER - 1, len(own))]


def continuations(longer):
    out = defaultdict(int)
    for g in {g for g, n in longer.items() if n}:
        out[g[1:]] += 1
    return out


def interpolated(counts, gram, lower, discount=DISCOUNT):
    context = [n for g, n in counts.items() if g[:-1] == gram[:-1] and n]
    if not context:
        return lower
    return (max(counts.get(gram, 0) - discount, 0) + sum(min(n, discount) for n in context) * lower) / sum(context)


class Plain:
    """Both classes' models, with every n-gram of the corpus at hand."""

    def __init__(self, classes, corpus):
        self.shared = {LOWEST + 1: dict.fromkeys({g for t in corpus for g in grams(t, LOWEST + 1)}, 1)}
        for k in range(LOWEST, 0, -1):
            self.shared[k] = continuations(self.shared[k + 1])
        self.own = []
        for texts in classes:
            top = defaultdict(int)
            for t in texts:
                for g in grams(t, ORDER):
                    top[g] += 1
            levels = {ORDER: top}
            for k in range(ORDER - 1, LOWEST - 1, -1):
                levels[k] = continuations(levels[k + 1])
            self.own.append(levels)

    def background(self, gram):
        p = 1 / 256
        for k in range(1, LOWEST + 1):
            p = interpolated(self.shared[k], gram[-k:], p, SHARED_DISCOUNT)
        return p

    def both(self, gram, discount=DISCOUNT):
        p = [self.background(gram)] * 2
        for k in range(LOWEST, ORDER + 1):
            p = [interpolated(self.own[c][k], gram[-k:], p[c], discount) for c in (0, 1)]
        return p

    def ratio(self, gram, discount=DISCOUNT):
        p = self.both(gram, discount)
        return math.log(p[1] / p[0])

    def feature(self, text, mixed=toxicity.MIXED, discount=DISCOUNT):
        """Mean over the different words of the log ratio, each word taken where it first stands."""
        own = b" " * (ORDER - 1) + b" " + language.symbols(text.lower().encode()).tobytes() + b" "
        found, at = {}, ORDER - 1
        for word in own[ORDER - 1 :].split(b" ")[:-1]:
            stop = at + len(word)
            if word and word not in found:
                found[word] = sum(self.ratio(own[i - ORDER + 1 : i + 1], discount) for i in range(at, stop + 1))
            at = stop + 1
        return sum(math.log(1 - mixed + mixed * math.exp(w)) for w in found.values()) / max(1, len(found))


def trained(spark):
    rows = [(i, t, c) for i, (t, c) in enumerate([(t, 0) for t in CLEAN] + [(t, 1) for t in TOXIC])]
    sample = spark.createDataFrame([(c, i % PARTS, t) for i, t, c in rows], "toxic int, part int, text string")
    corpus = spark.createDataFrame([(t,) for t in CLEAN + TOXIC + OTHER], "text string").repartition(3)
    counted, table = toxicity.window_counts(sample), toxicity.corpus_table(corpus)
    got = toxicity.shared_rows(table, counted).toArrow()
    shared = toxicity.Shared(*(got[c].to_numpy() for c in ("k", "key", "n", "kinds")))
    w = counted.orderBy("w").toPandas()
    counts = np.stack([sum(w[f"c{c * PARTS + p}"] for p in range(PARTS)) for c in (0, 1)])
    return table, shared, toxicity.train(w.w.to_numpy().view("u8"), counts, shared), w, counts


def test_corpus_table_counts_every_text(spark):
    table, shared, _, w, _ = trained(spark)
    plain = Plain((CLEAN, TOXIC), CLEAN + TOXIC + OTHER)
    assert {int(r.g).to_bytes(LOWEST): r.n for r in table.collect()} == dict(plain.shared[LOWEST])
    assert {r.g for r in table.collect()} - {int(x) & (1 << 8 * LOWEST) - 1 for x in w.w}  # also what no labelled text has
    keys = sorted({int(x) & (1 << 8 * LOWEST) - 1 for x in w.w})
    assert np.allclose(shared(np.array(keys, "u8")), [plain.background(k.to_bytes(LOWEST)) for k in keys])


def test_ratios_are_those_of_the_interpolated_models(spark):
    model = trained(spark)[2]
    plain = Plain((CLEAN, TOXIC), CLEAN + TOXIC + OTHER)
    texts = CLEAN + TOXIC + OTHER + ["the zugger", "zen", "z"]
    stream, ends = toxicity.streams(pa.array(texts))
    want = [plain.ratio(g) for t in texts for g in grams(t, ORDER)]
    assert np.allclose(toxicity.Scorer(model).ratios(stream, ends), want, rtol=0, atol=1e-9)
    features = toxicity.Scorer(model).features(pa.array(texts))
    assert np.allclose(features[:, 0], [plain.feature(t) for t in texts], rtol=0, atol=1e-9)


def test_models_sum_to_one(spark):
    _, shared, _, w, counts = trained(spark)
    plain = Plain((CLEAN, TOXIC), CLEAN + TOXIC + OTHER)
    for gram in [g for t in ["an old zuggo", "thé"] for g in grams(t, ORDER)]:
        assert np.allclose(np.sum([plain.both(gram[:-1] + bytes([b])) for b in range(256)], 0), 1)
    models = toxicity.class_models(w.w.to_numpy().view("u8"), counts, shared)
    for order, (key, p, context, left) in models.items():
        for i, name in enumerate(context.tolist()[::3]):
            own = np.flatnonzero(key >> np.uint64(8) == np.uint64(name))
            seen = {int(key[j]) & 255: j for j in own}
            for c in (0, 1):
                rest = 0.0
                for b in set(range(256)) - set(seen):
                    q = plain.background(((name << 8) + b).to_bytes(order)[-LOWEST:])
                    for k in range(LOWEST, order):
                        q = interpolated(plain.own[c][k], ((name << 8) + b).to_bytes(order)[-k:], q)
                    rest += left[c][3 * i] * q
                assert abs(p[c][own].sum() + rest - 1) < 1e-9


def test_a_text_is_scored_by_itself(spark):
    model = trained(spark)[2]
    model.weights, model.steps = (-1.0, 3.0), (np.array([-2.0, 0.0, 1.0]), np.array([0.0, 0.3, 1.0]))
    rng = np.random.default_rng(3)
    words = "the zugga and zugmo zugti then an old zugger inn tea é 日本 ! 7 it".split()
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) + rng.choice(["", " ", "  ! "]) for _ in range(300)] + ["", " ", None, " zugga", "z", "."]
    scorer = toxicity.Scorer(model)
    alone = np.array([scorer.scores(pa.array([t], pa.string()))[0] for t in texts])
    for order in (np.arange(len(texts)), rng.permutation(len(texts)), rng.permutation(len(texts))):
        got = scorer.scores(pa.array([texts[i] for i in order], pa.string()))
        assert (got == alone[order]).all()


def test_no_window_is_lost():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 1 << 48, 300_000).astype("u8"))
    value = rng.normal(size=len(key)).astype("f4")
    table = Probed(key, value)
    got, hit = table(key)
    assert hit.all() and (got == value).all()
    got, hit = table(key + np.uint64(1 << 50))
    assert not hit.any() and not got.any()
    got, hit = Probed(key[:0], value[:0])(key[:9])
    assert not hit.any()


def plain_calibration(x, y, prior=0.5, pseudo=toxicity.PSEUDO):
    """The weighted ridge logistic line by gradient steps, and the monotone means by the max-min formula."""
    scale = max(x.std(), 1e-9)
    z, share = x / scale, np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) / len(y)
    a = b = 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(a + b * z)))
        da, db = (share * (y - p)).sum() - 1e-9 * a, (share * z * (y - p)).sum() - 1e-5 * b
        h = (share * p * (1 - p))
        a, b = a + da / (h.sum() + 0.05), b + db / ((h * z * z).sum() + 0.05)
        if abs(da) + abs(db) < 1e-13:
            break
    line = a + b / scale * x
    weight = share * len(y)
    order = np.argsort(line, kind="stable")
    w, wy = weight[order], (weight * y)[order]
    n = len(y)
    mean = np.array([max(min(wy[i : k + 1].sum() / w[i : k + 1].sum() for k in range(j, n)) for i in range(j + 1)) for j in range(n)])
    out = np.empty(n)
    for value in np.unique(mean.round(12)):
        block = mean.round(12) == value
        more = pseudo * w[block].mean()
        out[block] = (wy[block].sum() + prior * more) / (w[block].sum() + more)
    return a, b / scale, line[order], np.maximum.accumulate(out)


def test_whole_score_equals_a_plain_one(spark):
    """Parts, choice of constants, models, calibration and score, all with dictionaries and slow formulas."""
    rng = np.random.default_rng(11)
    words = "the an inn pen tea on and then table old zen it".split()
    bad = ["zugga", "zugmo", "zugti"]

    def text(toxic):
        own = list(rng.choice(words, rng.integers(3, 9))) + (list(rng.choice(bad, rng.integers(1, 3))) if toxic and rng.random() < 0.8 else [])
        return " ".join(own)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(42)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, "zugga inn zugti"), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows] + [(5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, docs.select("text"))
    sample = [(r.toxic, r.part, r.text) for r in toxicity.labelled_sample(docs, labels, 5000).collect()]
    assert len(sample) == len({(r[1], r[2]) for r in rows}) or len({r[1] for r in rows}) < 42
    corpus = [r.text for r in docs.collect()]
    best = None
    for discount in toxicity.DISCOUNTS:
        found = []
        for part in range(PARTS):
            plain = Plain([[t for c, p, t in sample if c == k and p != part] for k in (0, 1)], corpus)
            found += [(c, [plain.feature(t, m, discount) for m in toxicity.MIXES]) for c, p, t in sample if p == part]
        y = np.array([c for c, _ in found], float)
        for i, m in enumerate(toxicity.MIXES):
            x = np.array([f[i] for _, f in found])
            right = np.mean([(a > b) + (a == b) / 2 for a in x[y == 1] for b in x[y == 0]])
            if best is None or right > best[0] + 1e-9:
                best = (right, discount, m, x, y)
    _, discount, mixed, x, y = best
    assert model.mixed == mixed
    a, b, at, value = plain_calibration(x, y)
    assert np.allclose(model.weights, (a, b), rtol=1e-5)
    plain = Plain([[t for c, _, t in sample if c == k] for k in (0, 1)], corpus)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for r in docs.collect():
        line = a + b * plain.feature(r.text, mixed, discount)
        want = 0.99 * np.interp(line, at, value) + 0.01 / (1 + math.exp(-line))
        assert abs(got[r.doc_id] - want) < 1e-4, r
