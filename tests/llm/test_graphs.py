"""Vectors, URL filter and the pipeline against plain versions."""

import math

import numpy as np
import pytest

from framewright.llm import urls, vectors

RULES = urls.RULES


def plain_vectors(rows, least=0.9):
    """(n_links, component) of each id by brute force."""
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v, "f8")))
    root, n = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, v) in enumerate(good):
        for q, (j, w) in enumerate(good):
            if p != q and len(v) == len(w) and (v @ w) / math.sqrt((v @ v) * (w @ w)) >= least:
                n[i] += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], top(i)) for i in root}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        base = rng.normal(size=20)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows) * 3, (base + rng.normal(size=20) * rng.choice([0, 0.05, 0.2])).astype("f4").tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # a hot vector
    rows += [(2000, None), (2001, [0.0] * 20), (2002, [float("nan")] * 20), (2003, [1.0, None] * 10), (2004, [1.0] * 3), (2010, [1.0, 1.0, 1.1]), (2011, [-1.0, 1.0, 1.1]), (2005, []), (2006, [float("inf")] * 20), (2007, (1e-30 * np.array(rows[0][1])).tolist()), (2008, (1e18 * np.array(rows[0][1])).tolist())]
    df = spark.createDataFrame([(i, v, 1, "h") for i, v in rows], "vec_id long, embedding array<float>, copies int, h string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, base_chunk=32, query_chunk=16).collect()}
    want = plain_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got == want
    exact = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df.withColumn("embedding", df.embedding.cast("array<double>")), spread=8.0).collect()}
    assert exact == want


def test_a_block_of_near_copies_is_small():
    import tracemalloc

    rng = np.random.default_rng(4)
    x = vectors.unit_rows(rng.normal(size=(1, 768)) + rng.normal(size=(1024, 768)) * 0.05)
    q = vectors.fitted(x[:300], 4)
    home = q.lists(x)
    code, miss = q.codes(x, home * 0)
    query, base = {"id": np.arange(1024), "unit": x}, {"id": np.arange(1024), "unit": x, "copies": np.ones(1024, "i8"), "code": code, "miss": miss}
    tracemalloc.start()
    total, joins = vectors.block_output(query, base, q, 0, 0.9)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert (total == ((x @ x.T >= 0.9).sum(1) - 1)).all() and total.min() > 1000
    assert sum(len(a) for a, _ in joins) <= 2048 and {int(v) for _, b in joins for v in b} == {0}


def test_vectors_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0]), (2, [0.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    one = spark.createDataFrame([(5, [3.0]), (4, [1.0]), (6, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(one).collect())) == [(4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]


def test_probes_bound_is_sure():
    rng = np.random.default_rng(9)
    x = vectors.unit_rows(rng.normal(size=(600, 16)))
    q = vectors.fitted(x, 20)
    near = vectors.unit_rows(x + rng.normal(size=x.shape) * 0.11)
    home, probe = q.lists(near), q.probes(x, 0.8, 1e9)  # the bound itself
    close = (x * near).sum(1) >= 0.8
    assert close.any() and probe[np.arange(len(x))[close], home[close]].all()


def spectrum(kind, n, rng, d=64):
    """Vectors of a low rank, or with variances that fall off, along random axes."""
    axes = np.linalg.qr(rng.normal(size=(d, d)))[0]
    size = (np.arange(d) < kind).astype(float) if isinstance(kind, int) else np.exp(-np.arange(d) / 6) if kind == "exponential" else 1 / (1 + np.arange(d))
    return (rng.normal(size=(n, d)) * size) @ axes.T


@pytest.mark.parametrize("kind", [2, 3, 4, 6, 8, 16, 32, 64, "exponential", "power"])
def test_probes_reach_all_links_at_the_default(spark, kind):
    """Links are whole whatever the vectors' intrinsic dimension, with near pairs among them."""
    rng = np.random.default_rng(77)
    x = spectrum(kind, 1800, rng)
    x = np.concatenate([x, x[:600] + spectrum(kind, 600, rng) * 0.3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    rows = vectors.near_vectors(df, trial=300).collect()
    got = np.array([r.n_links for r in sorted(rows, key=lambda r: r.vec_id)])
    assert got.sum() >= 0.999 * want.sum() and (got <= want).all()


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


PAGES = [
    ("http://A.Example.ORG/es/x?q", "<a href='https://b.example.net/z'>"), ("http://example.org/en/12", None), ("http://example.org/en/2", ""), ("https://x.com/fr/1#a", "<a href=\"http://good.net/\">"),
    ("https://bad.com/de/1", "<a href='http://x.com/'>"), ("http://worse.net/q", "<a href='http://bad.com/x'><img src=http://bad.com/i>"), ("http://good.net", "<a href='/rel'>"), (None, "<a href='http://x.com/'>"), ("no scheme", "x"),
    ("://", "y"), ("ftp://É.COM/fr/", "z"), ("http://notorg/", ""), ("http://org/", ""), ("http://good.net", "<a href='/rel'>"),
]


def test_rules_and_propagation(spark):
    df = spark.createDataFrame([(i, u, h, "x", 0.5) for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, verdict string, trust double")
    got = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    assert len(got) == len(PAGES)
    for i, (url, _) in enumerate(PAGES):
        host, path = plain_url(url)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert verdict in (None, got[i].verdict)
    assert got[5].verdict == "block" and got[6].verdict == "allow" and got[7].verdict == "allow"


def test_propagation_equals_numpy(spark):
    rng = np.random.default_rng(10)
    edges = {(int(a), int(b)): float(rng.integers(1, 4)) for a, b in rng.integers(0, 9, (25, 2)) if a != b}
    names = [f"h{i}.net" for i in range(9)]
    e = spark.createDataFrame([(names[a], names[b], w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    s = spark.createDataFrame([(names[0], 1.0, 0.0), (names[1], 0.0, 0.75), (names[2], 0.0, 0.25)], "host string, trust double, distrust double")
    one = {r.host: (r.trust, r.distrust) for r in urls.propagate(e, s).collect()}
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(e, s, tolerance=1e-9, block_edges=9).collect()}
    assert got.keys() == one.keys()
    m = np.zeros((9, 9))
    for (a, b), w in edges.items():
        m[a, b] = w
    share = lambda x: np.divide(x, x.sum(1, keepdims=True), out=np.zeros_like(x), where=x.sum(1, keepdims=True) > 0)
    for k, (p, seed) in enumerate([(share(m), np.eye(9)[0]), (share(m.T), 0.75 * np.eye(9)[1] + 0.25 * np.eye(9)[2])]):
        r = seed.copy()
        for _ in range(400):
            r = 0.15 * seed + 0.85 * r @ p
        for i, name in enumerate(names):
            assert one.get(name, (0.0, 0.0))[k] == pytest.approx(r[i], abs=2e-11) and got.get(name, (0.0, 0.0))[k] == pytest.approx(r[i], abs=1e-8)


def test_a_long_way_from_the_seed_is_gone(spark):
    """Hosts thirty links behind the only blocked one are as far blocked as the next."""
    pages = [(0, "http://b.com/de/", None), (1, "http://ok.org/", None)] + [(10 + i, f"http://h{i}/x", f"<a href='http://{'b.com' if i == 0 else f'h{i - 1}'}/'>") for i in range(30)]
    got = {r.page_id: (r.verdict, r.distrust_share) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert all(got[10 + i] == ("block", 1.0) for i in range(30)) and got[1][0] == "allow"


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "?? 12", "en", "s", 5), (10**6 + 3, None, None, None, None), (None, "the thing and of the other", "en", None, 3), (0, docs.where("doc_id = 0").first().text, "en", "s", 1)], docs.schema)
    now = docs.union(odd)
    start = now
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, now, sf_dir)
        if k < len(c.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
    ids = [r.doc_id for r in spark.read.parquet(str(tmp_path / "2")).collect()]
    assert len(ids) == len(set(ids)) and None in ids and not {10**6, 10**6 + 1, 10**6 + 2} & set(ids)
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == set(ids)
    assert len(ids) > 0.85 * start.count()
    empty = docs.limit(0)
    for _, stage in c.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0
