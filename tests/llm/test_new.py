"""Hard negatives, token counts and fill-in-middle against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import middle, negatives, queries, token_counts
from framewright.llm.tokens import Encoder, tokenizer_path
from test_queries import awkward, in_order, library_ids  # noqa: F401


def plain_negatives(rows, is_anchor, positives=5, count=5, least=80, scale=256):
    """All scores of all anchors, in whole numbers of any size."""
    known = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [int(np.floor(float(c) * scale)) for c in x]
        if sum(c * c for c in v) < 2**61:
            known[i] = min(known.get(i, (label, v)), (label, v))
    out = []
    for a in sorted(filter(is_anchor, known)):
        label, v = known[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, (other, w) in known.items() if i != a and len(w) == len(v))
        for p, pos, _ in [s for s in scored if s[2]][:positives]:
            window = [(i, -s) for s, i, same in scored if not same and least * -p <= 100 * -s <= 100 * -p][:count]
            out += [(a, pos, k, i, -p, s) for k, (i, s) in enumerate(window, 1)]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, label, None if x is None else [None if c is None else float(c) for c in x]) for i, label, x in rows], "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("seed, kind", [(1, "spread"), (2, "clusters"), (3, "copies"), (4, "large")])
def test_negatives_equal_all_scores(spark, seed, kind):
    rng = np.random.default_rng(seed)
    n = 700
    x = rng.normal(size=(n, 9)) / 3
    if kind == "clusters":
        x = rng.normal(size=(6, 9))[rng.integers(0, 6, n)] + x / 20
    if kind == "copies":  # a third is one vector, others tie
        x = np.round(x * 2) / 2
        x[rng.random(n) < 0.34] = x[0]
    if kind == "large":
        x = x * 1e5
    rows = [(int(i), int(rng.integers(0, 4)), x[i].tolist()) for i in range(n)]
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    got = negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, chunk=90, query_chunk=7, sample=150)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and (kind == "large" or len(want) > 300)


def test_negatives_of_awkward_rows(spark):
    rows = [(i, i % 3, [1.0 + i % 5, 0.5, -i % 7]) for i in range(40)]
    rows += [(40, None, [1.0, 1.0, 1.0]), (41, 1, None), (42, 1, [1.0, None, 2.0]), (43, 1, [float("nan"), 1.0, 1.0]), (44, 1, [float("inf"), 1.0, 1.0]), (45, 1, []), (46, 1, [1e300, 0.0, 0.0]), (None, 1, [1.0, 1.0, 1.0]), (60, 1, [3.0, 1.0]), (61, 1, [3.0, 1.1]), (62, 2, [2.9, 1.0]), (5, 0, [9.0, 9.0, 9.0]), (6, 0, [1.0, 0.5, -6.0]), (80, 7, [-50.0, -50.0, 90.0])]
    got = negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_negatives(rows, lambda i: i % 20 == 0))


def test_walks_are_exact_and_leave_parts_unread():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(8, 6))[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 6)) / 30))
    norms, labels, ids = (x**2).sum(1).astype("i8"), rng.integers(0, 3, 3000), rng.permutation(3000)
    walker = negatives.Walker(ids, labels, x, norms, float(norms.max()))
    read = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            read.append(len(self))
            return np.asarray(self) @ other

    walker.x = walker.x.view(Counted)
    for q in range(0, 3000, 100):
        score = x @ x[q]
        top = int(np.sort(score)[-700])
        low = int(0.8 * top)
        got = walker.nearest(x[q], int(norms[q]), int(ids[q]), int(labels[q]), False, low, top, 5)
        fits = (score >= low) & (score <= top) & (labels != labels[q])
        assert list(zip(*got, strict=True)) == [(i, -s) for s, i in sorted((-int(s), int(i)) for s, i in zip(score[fits], ids[fits], strict=True))[:5]]
    assert sum(read) < 0.7 * 30 * 3000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(spark, awkward, name):  # noqa: F811
    ids = library_ids(name, 0)
    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet")
    want = in_order((r[0], len((r[1] or "").encode()), len(ids(r[1])) - 1, len(ids(r[1])) > 1025) for r in awkward[1]["documents"])
    for block in (token_counts.BLOCK, 3000):
        assert in_order(tuple(r) for r in token_counts.count_tokens(docs, tokenizer_path(name), block=block).collect()) == want


def test_each_pretoken_is_counted_once(spark, awkward, tmp_path, monkeypatch):  # noqa: F811
    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet")
    blocks = token_counts.frequency_blocks(docs, tokenizer_path("byte_bpe_50k.json"), 2000)
    placed = blocks.select("block", F.posexplode("words").alias("i", "word"))
    asked = tmp_path / "asked"
    log = str(asked)

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            with open(log, "a") as out:
                out.write(repr(word) + "\n")
            return self.model.tokenize(word)

    def logged(path):
        own = Encoder(path)
        own.model = Model(own.model)
        return own

    monkeypatch.setattr(token_counts, "encoder", logged)
    found = token_counts.piece_counts(placed, tokenizer_path("byte_bpe_50k.json"))
    assert blocks.count() > 3 and found.count() == placed.count()
    words = asked.read_text().splitlines()
    assert len(words) == len(set(words)) == placed.where("word <> '<|endoftext|>'").select("word").distinct().count() < placed.count()


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_shrunk_numbers_come_back(n):
    x = np.random.default_rng(n).integers(0, 2**32, n)
    assert (token_counts.unshrunk(token_counts.shrunk(x)) == x).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 \n\t'.é日 　\U0001f600<|endoftext|>")), max_size=60), st.integers(1, 9))
def test_parts_do_not_change_pretokens(text, size):
    own = _encoder()
    assert "".join(token_counts.parts_of(text, size)) == text
    whole = sum(token_counts.frequencies(text, own).values())
    in_parts = sum(sum(token_counts.frequencies(p, own).values()) for s in text.split("<|endoftext|>") for p in token_counts.parts_of(s, size)) + text.count("<|endoftext|>")
    assert whole == in_parts


_made = []


def _encoder():
    _made or _made.append(Encoder(tokenizer_path("byte_bpe_50k.json")))
    return _made[0]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{suf}<P>{pre}<M>{mid}"
    else:
        form, out = "psm", f"<P>{pre}<S>{suf}<M>{mid}"
    cut = form != "plain"
    return (doc, len(units), form, len(pre) if cut else None, len(mid) if cut else None, out)


def test_fill_in_middle_equals_plain(spark, awkward):  # noqa: F811
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in awkward[1]["documents"]]
    rows += [(1000 + i, "".join(rng.choice("ab é日<P>\t\n\x0b SM") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(2000, "<P"), (2001, "> <S <M <"), (2003, "x<P>y"), (2004, " \t ")]
    rows += [(3000 + i, "wö rd " * 70_000 + "日" * 400_000 + " x  ") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).repartition(3)
    for every in (1, 3, 256):
        made = middle.fill_in_middle(docs, every=every)
        assert in_order(tuple(r) for r in made.collect()) == in_order(plain_middle(*r) for r in rows)
    assert in_order((r.doc_id, r.t) for r in made.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t")).collect()) == in_order((i, t or "") for i, t in rows)


def test_queries_digest_outputs_and_restored_texts(spark, awkward):  # noqa: F811
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*plain_middle(r[0], r[1])[:5], sha(plain_middle(r[0], r[1])[5]), sha(r[1] or "")) for r in awkward[1]["documents"]]
    assert in_order(tuple(r) for r in queries.queries()["op13_fill_in_middle"](spark, awkward[0]).collect()) == in_order(want)
    rows = [(i, None if label is None else (label + 1) % 10 if i % 7 == 0 else label, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x, label in awkward[1]["embeddings"]]
    got = queries.queries()["op11_hard_negatives"](spark, awkward[0]).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_negatives(rows, lambda i: i % 100 == 0)) and got


@pytest.mark.parametrize("window", [1, 2, 7, 1 << 20])
def test_checkpoints_over_windows(window):
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice("ab é日\t\n ") for _ in range(rng.randint(0, 50)))
        index, units = middle.Checkpoints(text.encode(), 4, window), UNIT.findall(text)
        assert (index.n, index.length) == (len(units), len(text))
        for u in range(len(units) + 1):
            assert index.cut(u) == (len("".join(units[:u]).encode()), len("".join(units[:u])))
    assert pa.array([text]).cast(pa.binary())[0].as_py() == text.encode()
