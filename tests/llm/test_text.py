"""Language, toxicity, near-duplicates, segmentation and packing against plain versions."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import graph, language, minhash, packing, segments, toxicity
from framewright.llm.base import group_minimum, spread_join
from framewright.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, rep string, score string"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "r", "s") for i, t in enumerate(texts)], DOCS)


def test_helpers_on_hot_groups(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)] + [(None, 5)], "k long, v long")
    got = group_minimum(rows, ["k"], "v").collect()
    assert len(got) == 201 and {r.leader for r in got} == {0}
    table = spark.createDataFrame([(0, "a"), (3, "b")], "k long, name string")
    assert spread_join(rows, table, ["k"], ["v"]).count() == 202


def test_a_cluster_needs_a_shared_folder():
    from framewright.llm import base

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "local-cluster[3,2,1024]"})

    with pytest.raises(ValueError, match="checkpoint"):
        base.shared_root(Session)
    Session.conf = Conf({"spark.master": "spark://x:7077", "spark.checkpoint.dir": "hdfs://a/b/"})
    assert base.shared_root(Session) == "hdfs://a/b"
    Session.conf = Conf({"spark.master": "local[4]"})
    assert base.shared_root(Session).startswith("file://") and Session.conf["spark.checkpoint.dir"]


def test_components(spark):
    rng = random.Random(0)
    for n, m in ((1, 0), (40, 25), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in rng.sample(range(100, 400), 300)]
        root = {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: top(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_phrases(text: bytes, sample: bytes) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_a_plain_parse():
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 5)))
    samples = {"x": " ".join(word("abcd") for _ in range(60)).encode(), "y": " ".join(word("cdeé") for _ in range(60)).encode()}
    parser = language.CrossParser(samples, chunk=10_000)
    texts = [" ".join(word("abcdefé") for _ in range(rng.randint(0, 40))) for _ in range(25)] + ["", "ZZ!!", "a", "é" * 50]
    count, size = parser.phrases(pa.array(texts))
    for i, t in enumerate(texts):
        own = language.symbols(t.lower().encode()).tobytes()
        assert size[i] == len(own)
        for k, name in enumerate(parser.languages):
            assert count[i, k] == plain_phrases(own, language.symbols(samples[name]).tobytes()), (t, name)
    short, _ = language.CrossParser(samples, chunk=16).phrases(pa.array(texts))
    assert (short >= count).all() and (short <= count + np.ceil(size / 16)[:, None]).all()


def test_language_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = language.labelled_samples(docs.where(language.fold(4) != 2).select("text", "lang"))
    assert set(samples) <= {"en", "de", "fr", "es"} and all(len(v) <= 40_000 + 4 * 8192 for v in samples.values())
    rows = docs_of(spark, [None, "", "12 34 !!", "the and of thing", "日本", "x" * 200_000])
    got = {r.doc_id: r for r in language.identify(rows, samples, ["doc_id", "score"], {"lang_pred": "a", "score": "b"}).collect()}
    assert [got[i].a for i in range(3)] == ["und"] * 3 and all(got[i].a in samples for i in (3, 4, 5))
    assert all(0 <= r.b <= 1 for r in got.values()) and got[0].score == "s"
    assert (got[4].symbols, got[4].known, got[5].symbols) == (6, 0, 200_000) and got[3].known == got[3].symbols == 16
    held = language.op7_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    nothing = language.identify(rows, {}, ["doc_id"]).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(rows.limit(0), samples, ["doc_id"]).count() == 0
    assert language.labelled_samples(spark.createDataFrame([(None, "en"), ("abc", None), ("", "de")], "text string, lang string")) == {}


def toxic_tables(spark, n=260):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "an", "er", "in", "on", "ed", "re", "st"]) for _ in range(rng.randint(1, 4)))
    bad = lambda: "zug" + rng.choice(["ga", "mo", "ti", "ra", "lu", "pe"])
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [word() for _ in range(rng.randint(30, 90))]
        if toxic:
            for _ in range(rng.randint(3, 8)):
                words.insert(rng.randrange(len(words)), bad())
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs.where(language.fold(3) != 1), labels.where(language.fold(3) != 1), docs.select("text"))
    got = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(language.fold(3) == 1).collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    assert np.mean([(a > s[y == 0]).mean() for a in s[y == 1]]) > 0.98
    assert (s[y == 1] >= 0.7).mean() > 0.8 and (s[y == 0] >= 0.7).mean() < 0.05
    odd = docs_of(spark, [None, "", "?", "zugga", "th " * 60_000])
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model, ["doc_id", "rep"], "s2").withColumnRenamed("s2", "score").collect()}
    assert len(scores) == 5 and all(0 <= v <= 1 for v in scores.values()) and scores[0] == scores[1]
    assert toxicity.score(odd.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark, 12)
    model = toxicity.fit(docs, labels.limit(0), docs.select("text"))
    assert {round(r.score, 6) for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {0.5}
    odd = labels.union(labels.selectExpr("doc_id", "1 - toxic")).union(labels.selectExpr("doc_id + 100", "cast(null as int)"))
    assert toxicity.labelled_sample(docs, odd, 10).count() == 0


def test_steps_are_monotone():
    x, y = toxicity.monotone(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.allclose(np.interp([1, 2, 3, 4], x, y), [0, 0.5, 0.5, 1])
    x, y = toxicity.monotone(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4), 2.0)
    assert np.allclose(np.interp([1, 2, 3, 4], x, y), [1 / 3, 0.5, 0.5, 2 / 3])


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 1 << 63, 60).astype("u8")
    a, b = rng.random(60) * 5, rng.random(60) * 5
    a[:10] = 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    both = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    s = minhash.dart_signatures(elements[both], np.concatenate([a[a > 0], b[b > 0]]), owner, 3, 4000)
    assert abs((s[0] == s[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)
    assert not s[2].any() and s[:2].all()


def plain_classes(rows, least=0.8):
    by = defaultdict(set)
    for i, t in rows:
        by[i].add(t or "")
    items = [(i, t) for i, ts in by.items() for t in ts]
    sets = minhash.sets_of(pa.array([t for _, t in items]))
    root = {i: i for i in by}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(items)):
        for q in range(p):
            if (minhash.similarity(sets[p], sets[q]) >= least) or (not len(sets[p][0]) and items[p][1] == items[q][1]):
                x, y = top(items[p][0]), top(items[q][0])
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in by}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, at = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if rng.random() < 0.5:
            base = base[:40] + passage
        for edits in [0, 0, 1, 2, 4, 8, 14]:
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((at, " ".join(own)))
            at += 1
    big = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(60):  # a group of copies at all distances
        own = list(big)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append((at, " ".join(own).upper()))
        at += 1
    rows += [(900, None), (901, ""), (902, "?!"), (903, "?!"), (904, "one two"), (905, "One, two."), (906, "one two three"), (3, rows[3][1]), (907, "w " * 30_000), (908, "w " * 30_001)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, key int").repartition(3)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    want = plain_classes(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_pair_meets_in_its_first_common_bucket():
    sets = np.arange(40, dtype="<u8")
    sign = np.zeros(8, "<u2").tobytes()  # the cut darts agree everywhere
    row = lambda rep, chunk, *bands: (rep, rep, chunk, sign, sets.tobytes(), np.array(bands, "<u8").tobytes())
    apart = [row(1, "-/0", 7, 9), row(2, "-/1", 8, 9)]  # the first bands differ
    assert minhash.links_within(apart, 9, True, 0.8, 4) == [(1, 2)]
    assert minhash.links_within(apart, 9, False, 0.8, 4) == [(1, 2)]
    both = [row(1, "-/0", 7, 9), row(2, "-/0", 7, 9)]
    assert minhash.links_within(both, 9, False, 0.8, 4) == [] and minhash.links_within(both, 7, False, 0.8, 4) == [(1, 2)]
    assert minhash.links_within(both, 7, True, 0.8, 4) == []  # their chunk's own block has them
    same = [row(1, "-/0", 7, 9), (2, 1, *row(2, "-/0", 7, 9)[2:])]
    assert minhash.links_within(same, 7, False, 0.8, 4) == []


@pytest.mark.parametrize("chunk", [2, 3, 256])
def test_blocks_find_what_joins_components(spark, chunk):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts, component = [], []
    for k in range(8):  # eight groups of equal texts, neighbouring groups alike
        text = [*base[4 * k :], *(f"x{k}y{i}" for i in range(4 * k))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(text))
            component.append(len(texts) if texts.count(texts[-1]) == 1 else component[-1])
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    signed = minhash.signatures(docs, 20, 4).collect()
    apart = spark.createDataFrame([(b, r.doc_id, component[r.doc_id - 1]) for r in signed for b in r.bands], "bucket long, rep long, component long")
    members = minhash.block_rows(docs, apart, 20, 4)
    got = minhash.block_links(members, apart, 0.8, 80, chunk).collect()
    assert all(component[r.a - 1] != component[r.b - 1] for r in got)
    root = {c: c for c in component}
    top = lambda x: x if root[x] == x else top(root[x])
    for r in got:
        root[top(component[r.a - 1])] = top(component[r.b - 1])
    sets = minhash.sets_of(pa.array(texts))
    for i in range(len(texts)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= 0.8:
                assert top(component[i]) == top(component[j])


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str) == [(4, 4, True), (None, None, True)]


TEXTS = ["", None, " ", "  two  spaces ", "▁mark▁", "naïve 日本語 🤖\n\ttab", "x" * 5000, "\x00\x01", "plain words here " * 4000, " " * 500]


def test_segmentation_is_lossless_and_reproducible(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    docs = docs_of(spark, TEXTS)
    first = segments.sampled(docs.repartition(1), path).collect()
    again = {r.doc_id: r.ids for r in segments.sampled(docs.repartition(5), path).collect()}
    assert {r.doc_id: r.ids for r in first} == again
    back = segments.decoded(segments.sampled(docs, path), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    other = {r.doc_id: r.ids for r in segments.sampled(docs, path, seed=1).collect()}
    assert other[8] != again[8] and again[0] == [] == again[1]
    assert segments.sampled(docs.limit(0), path).count() == 0


def plain_lattice(theta=1.0):
    """surface -> (id, weight) of all pieces, and the weight of a byte, straight from the model's file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i).replace("▁", " ")] = (i, (2 - min(model.get_score(i), 0.0)) ** -theta)
    byte = {bytes([b]): model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
    return pieces, byte, (2 + 2 * model.get_piece_size()) ** -theta


def plain_edges(text, lattice):
    """(start, end, ids, weight) over the characters of a text with a space in front; no piece has a space inside."""
    pieces, byte, least = lattice
    out = []
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 30) + 1):
            own = text[i:j]
            if own in pieces and " " not in own.lstrip(" "):
                out.append((i, j, (pieces[own][0],), pieces[own][1]))
        if text[i] not in pieces:
            own = text[i].encode()
            out.append((i, i + 1, tuple(byte[own[k : k + 1]] for k in range(len(own))), least ** len(own)))
    return out


@pytest.mark.parametrize("text", ["the", "a b", "日x"])
def test_sampling_follows_the_lattice(text):
    lattice = segments.lattice_of(tokenizer_path("piece_bpe_32k.model"), 1.0)
    own = " " + text
    edges = plain_edges(own, plain_lattice())
    paths = defaultdict(float)

    def walk(at, ids, w):
        if at == len(own):
            paths[ids] += w
            return
        for s, e, p, x in edges:
            if s == at:
                walk(e, ids + p, w * x)

    walk(0, (), 1.0)
    whole = sum(paths.values())
    n = 20_000
    seen = defaultdict(int)
    for ids in lattice.sample([text] * n, segments.row_seeds(list(range(n)), 3)):
        seen[tuple(ids.tolist())] += 1
    assert set(seen) <= set(paths)
    for ids, w in paths.items():
        p = w / whole
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_long_runs_are_one_lattice():
    lattice = segments.lattice_of(tokenizer_path("piece_bpe_32k.model"), 1.0)
    text = "https://example.org/some/quite/long/path/without/a/space/and/then/even/more-of-it?x=1&y=22日本語中文のテキストinternationalization" + "x" * 70
    own, pieces = " " + text, plain_lattice()
    edges = plain_edges(own, pieces)
    ahead, back = [0.0] * (len(own) + 1), [0.0] * (len(own) + 1)
    ahead[0] = back[-1] = 1.0
    for s, e, _, w in sorted(edges):
        ahead[e] += ahead[s] * w
    for s, e, _, w in sorted(edges, reverse=True):
        back[s] += back[e] * w
    n = 4000
    seen = defaultdict(int)
    at_of = [len(own[:i].encode()) for i in range(len(own) + 1)]
    for ids in lattice.sample([text] * n, segments.row_seeds(list(range(n)), 5)):
        at = 0
        for i in ids.tolist():
            seen[at, at + len(lattice.surface[i])] += 1
            at += len(lattice.surface[i])
        assert at == at_of[-1]
    for s, e, ids, w in edges:
        if len(ids) == 1:
            p = ahead[s] * w * back[e] / ahead[-1]
            assert abs(seen[at_of[s], at_of[e]] / n - p) < 5 * math.sqrt(max(p * (1 - p), 0) / n) + 2e-3, own[s:e]
    assert len(lattice.sample(["z" * 200_000], segments.row_seeds([1], 0))[0]) > 1000


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize(("open_bins", "fan_in"), [(64, 16), (2, 2), (1, 4)])
def test_packing(spark, open_bins, fan_in):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randint(0, 90))) for _ in range(400)] + [None, "", "word " * 400, "a <|endoftext|> b"]
    docs = docs_of(spark, texts).union(docs_of(spark, ["one two", "x"], 5)).union(spark.createDataFrame([(None, "null id", "r", "s")], DOCS)).repartition(7)
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, 0, capacity=128, open_bins=open_bins, fan_in=fan_in).collect()
    library = Tokenizer.from_file(path)
    want = []
    for doc, text in [*enumerate(texts), (5, "one two"), (6, "x"), (None, "null id")]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(-1 if doc is None else doc, k, at, len(ids[at : at + 128]), zlib.crc32(np.array(ids[at : at + 128], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 128))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    least = math.ceil(sum(w[3] for w in want) / 128)
    assert check_packing(rows, 128) <= (1.01 if open_bins == 64 else 1.5) * least + 1
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.add(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [p.add(n)[0] for n in (6, 7, 8)] == [2, 3, 4] and p.still_open() == {2, 4}
    with pytest.raises(IndexError):
        packing.BestFit(10, 2)._take(3)


def test_waiting_pieces_leave_when_their_bin_closes():
    placed = packing.Placed(packing.BestFit(10, 2))
    for i, n in enumerate((6, 7, 3, 4, 6, 7, 8)):
        placed.add(None if i == 2 else i, 0, 0, n, 9)
    first, last = placed.flush().to_pylist(), placed.flush(True).to_pylist()
    assert [r["doc_id"] for r in first] == [0, 1, None, 3, 5] and all(r["done"] for r in first)
    assert [(r["doc_id"], r["sequence_id"], r["done"]) for r in last] == [(4, 2, False), (6, 4, False)]
