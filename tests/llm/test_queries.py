"""Every query of the operators on awkward tables, on empty ones and against its SQL."""

import hashlib
import math
import random
import zlib

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import language, media, minhash, packing, queries, segments, urls
from framewright.llm.tokens import tokenizer_path
from test_graphs import plain_rule, plain_url, plain_vectors
from test_text import check_packing, plain_classes, plain_phrases

CLASHES = "ids start n_tokens component_id kept key rep score predicted held_out lang_pred toxic part w raw home copies h embedding piece sequence_id offset done host path links verdict rule digest file seq".split()
LONG = "the and of thing in that with there " * 9000
BAD = ["zugga", "zugmo", "zugti", "zugpe", "zuggaan"]
SYLLABLES = {"en": ["th", "an", "er", "in", "on"], "de": ["sch", "ein", "ung", "er", "ge"]}


def text_of(rng, lang, toxic=False):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
    for _ in range(rng.randint(3, 7) if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


def document_rows():
    rng = random.Random(31)
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        rows.append([i, text_of(rng, lang, i % 4 == 0), lang, "s" if i % 3 else None, i])
    rows += [[300 + i, t, None, None, None] for i, t in enumerate([None, "", " ", "?! 12", "a", "<|endoftext|> x <|endoftext|>", "日本語 テキスト " * 40, "naïve ﬀ İ \t\r\n", LONG, LONG + "x", "http://x.org/" + "ab" * 300])]
    rows += [[400 + i, rows[5][1], "en", "s", 1] for i in range(12)]  # copies
    near = rows[7][1].split()
    rows += [[420 + i, " ".join([*near[:-1], f"word{i}"]), "de", "s", 1] for i in range(4)]
    rows += [list(rows[3]), list(rows[3]), [4, rows[9][1], "en", "s", 1], [None, rows[2][1], "en", "s", 1], [None, None, None, None, None]]
    return rows


def write(spark, folder, name, rows, schema):
    clash = [c for c in CLASHES if c not in schema.split()[::2]]
    df = spark.createDataFrame([tuple(r) for r in rows], schema)
    df.select("*", *(F.lit("clash").alias(c) for c in clash)).repartition(3).write.parquet(f"{folder}/{name}.parquet")


SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars int",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def tables():
    rng = np.random.default_rng(17)
    docs = document_rows()
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240)] + [(0, 1, 0), (1, None, None), (None, 1, 1), (9999, 0, 1), (2, 0, 0)]
    big = "é" * 600
    pages = [(1, "http://A.Example.ORG/es/x?q", big), (2, None, big), (2, "http://x/", big), (3, "https://x.com/fr/1#a", "<a href='//B.example.net/z'><a href=HTTP://É.com/q>"), (4, "://", None), (5, "http://É.COM/de/1", ""), (5, "http://É.COM/de/1", ""), (None, "no scheme", big), (6, "http://b.example.net/q", "<a href='http://bad.com/x'><img src=//bad.com/i>" + "x" * 2000), (7, "http://bad.com/de/1", "<a href='/rel'>"), (8, "http://notorg/" + "p" * 5000, "y" * 3_000_000), (9, "http://org/", None)]
    pages += [(100 + i, f"http://h{i % 9}.net/{i}", "".join(f"<a href='http://h{j}.net/'>" for j in rng.integers(0, 12, 4)) + "<a href='http://hub.org/x'>") for i in range(60)]
    base = rng.normal(size=(12, 20))
    vectors = [(i, (base[i % 12] + rng.normal(size=20) * 0.1).astype("f4").tolist(), 0) for i in range(60)]
    vectors += [(100 + i, vectors[0][1], 1) for i in range(10)] + [(200, None, None), (201, [0.0] * 20, 1), (202, [float("nan")] * 20, 1), (203, [1.0, None], 1), (204, [], 1), (205, [1.0, 2.0], 1), (206, [1.0, 2.1], 1), (207, [1.0, 2.0], 1)]
    return {"documents": docs, "labels": labels, "pages": pages, "embeddings": vectors}


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder, made = str(tmp_path_factory.mktemp("awkward")), tables()
    for name, rows in made.items():
        write(spark, folder, name, rows, SCHEMAS[name])
    return folder, made


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in SCHEMAS.items():
        write(spark, folder, name, [], schema)
    return folder


def run(spark, name, folder):
    return queries.queries()[name](spark, folder)


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert run(spark, name, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, sf_dir, name):
    con = compare.connect(sf_dir)
    assert compare.differences(run(spark, name, sf_dir), con, queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["op1_warc", "op9_url_filter"])
def test_awkward_pages_equal_sql(spark, awkward, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{awkward[0]}/pages.parquet/*.parquet')")
    mine = run(spark, name, awkward[0]).drop(*(["url"] if name == "op1_warc" else []))
    sql = queries.oracle_sql()[name]
    assert compare.differences(mine, con, f"SELECT * EXCLUDE (url) FROM ({sql})" if name == "op1_warc" else sql) == ""


def test_urls_are_judged_by_host_and_path(spark, awkward):
    got = run(spark, "op9_url_filter", awkward[0]).collect()
    want = [(i, *plain_url(u), plain_rule(*plain_url(u))[0]) for i, u, _ in awkward[1]["pages"]]
    assert in_order((r.page_id, r.host, r.path, r.rule) for r in got) == in_order(want)


def test_hubs_in_parts_give_the_same_ranks(spark, awkward):
    pages = spark.read.parquet(f"{awkward[0]}/pages.parquet")
    read = pages.select(urls.host_and_path(F.col("url"))[0].alias("host"), F.coalesce(urls.linked_hosts(F.col("html")), F.array().cast("array<string>")).alias("links"))
    edges = urls.host_edges(read)
    seeds = spark.createDataFrame([("hub.org", 0.5, 0.0), ("h1.net", 0.5, 0.25), ("bad.com", 0.0, 0.75)], "host string, trust double, distrust double")
    one = {r.host: (r.trust, r.distrust) for r in urls.propagate(edges, seeds).collect()}
    for block, share in ((100, 10_000), (50, 3), (10**6, 2)):
        got = {r.host: (r.trust, r.distrust) for r in urls.propagate(edges, seeds, tolerance=1e-6, block_edges=block, share=share).collect()}
        assert got.keys() == one.keys() and all(got[h] == pytest.approx(one[h], abs=1e-5) for h in one)


def library_ids(name, end):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, awkward):
    ids = library_ids("byte_bpe_50k.json", 2)
    at, want = 0, []
    for doc, text in sorted(((r[0], r[1] or "") for r in awkward[1]["documents"]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        own = ids(text)
        want.append((doc, at, len(own), crc(own)))
        at += len(own)
    got = run(spark, "op2_token_files", awkward[0]).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_near_duplicates(spark, awkward):
    rows = [(r[0], r[1]) for r in awkward[1]["documents"]]
    got = run(spark, "op3_near_duplicates", awkward[0]).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted(plain_classes([r for r in rows if r[0] is not None]).items())
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_sampled_pieces(spark, awkward):
    lattice = segments.Lattice(tokenizer_path("piece_bpe_32k.model"))
    got = in_order(tuple(r) for r in run(spark, "op4_sampled_pieces", awkward[0]).collect())
    want = []
    for doc, text, *_ in awkward[1]["documents"]:
        ids = lattice.sample([text or ""], segments.row_seeds([doc], 0))[0]
        assert lattice.decode(ids) == (text or "")
        want.append((doc, len(ids), crc(ids), zlib.crc32((text or "").encode()), True))
    assert got == in_order(want)


def test_media(spark, awkward):
    want = []
    for doc, text, *_ in awkward[1]["documents"]:
        own = (text or "").encode()
        payload = own + b" " * (max(192, -(-len(own) // 192) * 192) - len(own))
        want.append((doc, len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = run(spark, "op5_media", awkward[0]).collect()
    assert in_order((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == in_order(want)
    for r in got:
        lead = (r.doc_id or 0) % 3
        assert (r.position, r.caption, r.before, r.after) == (1 + lead, f"{r.n_bytes} bytes", f"Part {lead - 1} before {r.doc_id}" if lead else f"Document {r.doc_id}", f"End of {r.doc_id}")
    stored = {}
    for r in got:
        assert stored.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    png = media.to_png(media.padded(b""))
    assert stored[hashlib.sha256(b" " * 192).hexdigest()][:2] == (len(png), hashlib.sha256(png).hexdigest())


def test_near_vectors(spark, awkward):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in awkward[1]["embeddings"]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, "op6_near_vectors", awkward[0]).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in plain_vectors(rows).items()}


def plain_language(samples, text):
    """Language of least phrases times bits, phrases cut every 1,024 symbols."""
    if not text or not any(c.isalpha() for c in text):
        return "und"
    own = language.symbols(text.lower().encode()).tobytes()
    parsed = {}
    for name in sorted(samples):
        sample = language.symbols(samples[name]).tobytes()
        parsed[name] = sum(plain_phrases(own[k : k + 1024], sample) for k in range(0, len(own), 1024)) * math.log2(max(2, len(sample)))
    return min(parsed, key=lambda n: (parsed[n], n))


def fold(doc, modulus):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % modulus


def test_language(spark, awkward):
    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet")
    samples = language.labelled_samples(docs.where(language.fold(4) != 2).select("text", "lang"))
    got = run(spark, "op7_language", awkward[0]).collect()
    rows = [r for r in awkward[1]["documents"] if len(r[1] or "") < 5000]
    want = in_order((r[0], fold(r[0], 4) == 2, plain_language(samples, r[1])) for r in rows)
    long = {r[0] for r in awkward[1]["documents"]} - {r[0] for r in rows}
    assert in_order((r.doc_id, r.held_out, r.lang_pred) for r in got if r.doc_id not in long) == want
    assert {r.lang_pred for r in got if r.doc_id in long} == {"en"} and all(0 <= r.score <= 1 for r in got)


def test_toxicity(spark, awkward):
    docs = awkward[1]["documents"]
    got = run(spark, "op8_toxicity", awkward[0]).collect()
    assert in_order((r.doc_id, r.held_out, r.predicted) for r in got) == in_order((r.doc_id, fold(r.doc_id, 3) == 1, int(r.score >= 0.7)) for r in got)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got if r.doc_id != 4}
    assert score[300] == score[301] == score[302] and len({score[400 + i] for i in range(12)} | {score[5]}) == 1
    held = [i for i in range(240) if fold(i, 3) == 1 and i != 4]
    assert np.mean([score[i] >= 0.7 for i in held if i % 4 == 0]) > 0.8 and not any(score[i] >= 0.7 for i in held if i % 4)


def test_packing(spark, awkward):
    ids = library_ids("word_bpe_49k.json", 0)
    want = []
    for doc, text, *_ in awkward[1]["documents"]:
        own = ids(text)
        want += [(doc, k, at, len(own[at : at + 2048]), crc(own[at : at + 2048])) for k, at in enumerate(range(0, len(own), 2048))]
    got = run(spark, "op10_packing", awkward[0]).collect()
    assert in_order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == in_order(want)
    assert check_packing(got, 2048) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_pipeline_decisions(spark, awkward, tmp_path):
    """Each stage on its own input, its decisions made again one text at a time."""
    import corpus_pipeline as c

    def rows(df):
        return in_order(tuple(r) for r in df.collect())

    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet").withColumn("toxicity", F.lit(1)).withColumn("_toxicity", F.lit(1)).withColumn("_lang_pred", F.lit("x"))
    stages, after = dict(c.STAGES), {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, awkward[0])
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        after[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{name}"))
    assert list(stages) == ["toxicity", "language", "near_duplicates", "packing"]

    before, kept = after["toxicity"]
    labels = spark.read.parquet(f"{awkward[0]}/labels.parquet").select("doc_id", "toxic")
    model = c.toxicity.fit(before.where(language.fold(3) != 1).select("doc_id", "text"), labels.where(language.fold(3) != 1), before.select("text"))
    scorer = c.toxicity.Scorer(model)
    assert rows(kept) == in_order(tuple(r) for r in before.collect() if scorer.scores(pa.array([r.text], pa.string()))[0] < 0.7)
    assert kept.count() < before.count() - 40

    before, kept = after["language"]
    samples = language.labelled_samples(before.where(language.fold(4) != 2).select("text", "lang"))
    parser = language.CrossParser(samples)

    def stays(text):
        if plain_language(samples, text) == "und":
            return False
        own = language.symbols(text.lower().encode()).tobytes()
        known = sum(bytes([b]) in b"".join(samples.values()) or b == 32 for b in own)
        phrases = parser.phrases(pa.array([text]))[0][0][parser.languages.index(language.predictions(pa.array([text]), parser)[0][0])]
        return not (len(own) / phrases < c.LEAST_PHRASE and known >= c.LEAST_KNOWN and 2 * known >= len(own))

    assert rows(kept) == in_order(tuple(r) for r in before.collect() if stays((r.text or "")[:20_000]))

    before, kept = after["near_duplicates"]
    classes = plain_classes([(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None])
    assert rows(kept) == in_order({tuple(r) for r in before.collect() if r.doc_id is not None and classes[r.doc_id] == r.doc_id} | {tuple(r) for r in before.collect() if r.doc_id is None})

    before, packed = after["packing"]
    ids = library_ids("word_bpe_49k.json", 0)
    assert sorted((-1 if r.doc_id is None else r.doc_id, sum(len(x) for x in [ids(r.text)])) for r in before.collect()) == sorted((r.k, r.n) for r in packed.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("k")).agg(F.sum("length").alias("n")).collect())
    assert check_packing(packed.collect(), 2048) <= -(-packed.agg(F.sum("length")).first()[0] // 2048) + 1
    assert rows(c.run(spark, awkward[0]).select("doc_id", "piece", "length")) is not None
