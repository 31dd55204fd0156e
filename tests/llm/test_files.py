"""Archives, token files and media: exact round trips on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from framewright.llm import media, token_files, tokens, warc
from framewright.llm.base import new_folder
from framewright.llm.tokens import encoder, tokenizer_path

ADDED = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "a<|endoftext|>", " <|endoftext|>b", "<|endoftext", "12<|startoftext|>'s"]
LONG = "naïve wörd, it's 12 o'clock \t\n" * 3000
TEXTS = ["", None, " ", "a", LONG, "it's  we'll 'tis 'S\n\n x", "日本語 mixed ﬀ İstanbul <|endoftext|>", "a", "tab\tnew\r\n  end  "]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(name))
    own = encoder(tokenizer_path(name), 50)  # so few that the memory starts anew within a text
    for text in [t or "" for t in TEXTS] + ["x'sy 've'll ''s 's 't's", "¡Ñandú! ½ ² ª º µ", " nb sp", "é combining", "ǅ Ǆ ɏ"]:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("pattern", [tokens.BYTE_PATTERN, tokens.WORD_PATTERN])
def test_explicit_sets_split_as_unicode_classes(pattern):
    draw = random.Random(3)
    pool = [c for c in map(chr, range(0x250)) if not tokens.UNSURE.search(c)] + ["'s", "'t", "'re", "'ll", "'", *["  "] * 20, "\n\n", "\t"]
    plain, fast = regex.compile(pattern).findall, tokens.sure_pattern(pattern).findall
    for _ in range(20_000):
        text = "".join(draw.choices(pool, k=draw.randrange(40)))
        assert fast(text) == plain(text) and fast(text.lower()) == plain(text.lower())


@pytest.mark.parametrize("delta", [False, True])
def test_token_files_round_trip(spark, delta):
    docs = documents(spark).union(spark.createDataFrame([(None, "null id", "x", 1), (3, "a", "y", 2)], "doc_id long, text string, ids string, start int"))
    folder, path = new_folder(spark, "t"), tokenizer_path("byte_bpe_50k.json")
    index = token_files.write_token_files(docs, folder, path, 2, group_tokens=64, delta=delta)
    rows = token_files.read_row_groups(index, folder, ["doc_id", "ids"], token_files.digests, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    encode = encoder(path).encode
    want, at = [], 0
    for doc, text in [(None, "null id")] + sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(3, "a")]):
        ids = encode(text) + np.array([2], "<u4").tobytes()
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    some = {r.doc_id: r.ids for r in token_files.read_documents(index, folder, [0, 5]).collect()}
    assert np.array(some[5], "<u4").tobytes() == encode(TEXTS[5]) + np.array([2], "<u4").tobytes() and len(some[0]) == 1
    assert token_files.read_documents(index, folder, []).count() == token_files.read_documents(index, folder, [10**9]).count() == 0


@pytest.mark.parametrize("delta", [False, True])
def test_other_pages_and_columns_stay_unread(spark, delta):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    docs = documents(spark, [" ".join(rng.choice(words, 6000)) for _ in range(60)]).repartition(1)
    folder = new_folder(spark, "t")
    index = token_files.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), 2, delta=delta)
    file, first, last = index.orderBy("least_doc").select("file", "least_doc", "largest_doc").first()
    path = f"{folder.removeprefix('file://')}/{file}"
    group = pq.ParquetFile(path).metadata.row_group(0)
    assert last - first > 20
    whole = {r.doc_id: r.ids for r in token_files.read_documents(index, folder, [first, last]).collect()}
    chunk = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}["ids.list.element"]
    end = min(chunk.dictionary_page_offset or chunk.data_page_offset, chunk.data_page_offset) + chunk.total_compressed_size
    with open(path, "r+b") as f:  # spoil the last page of the row group's ids
        f.seek(end - 2000)
        f.write(b"\xff" * 2000)
    assert token_files.read_documents(index, folder, [first]).first().ids == whole[first]
    sizes = {r.doc_id: r.n_tokens for r in token_files.read_documents(index, folder, [first, last], ("doc_id", "n_tokens")).collect()}
    assert sizes == {k: len(v) for k, v in whole.items()}
    with pytest.raises(Exception):  # noqa: B017
        token_files.read_documents(index, folder, [last]).collect()


def test_a_shared_doc_id_is_dealt_to_many_ranges(spark):
    texts = [f"text {i} of one document " * (i % 7 + 1) for i in range(400)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, t) for t in texts] + [(9, "last")], "doc_id long, text string").repartition(8)
    folder = new_folder(spark, "ranges-test")
    index = token_files.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), 2, range_bytes=4_000)
    per_file = [r.n for r in index.groupBy("file").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(per_file) == 801 and len(per_file) > 10 and max(per_file) < 200
    rows = sorted(token_files.read_row_groups(index, folder, ["doc_id", "ids"], token_files.digests, "doc_id long, start long, n_tokens long, ids_crc32 long").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 400 + [7] * 400 + [9]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(801)]


def test_empty_tables(spark):
    docs = documents(spark, [])
    folder = new_folder(spark, "t")
    index = token_files.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), 2)
    assert token_files.read_row_groups(index, folder, ["doc_id", "ids"], token_files.digests, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    a, b = new_folder(spark, "w"), new_folder(spark, "w")
    manifest = warc.write_monolithic(pages, a)
    assert warc.read_records(warc.normalise(manifest, warc.revisits(manifest), a, b), b).count() == 0
    assert media.store_documents(docs, new_folder(spark, "m")).count() == 0


def test_archive_rows(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://a/ b\n", "short"), (4, "u", "short"), (5, "u", None), (6, "u", other), (6, "u", other), (None, "u", big), (7, "u", "z" * 999), (8, "u", "z" * 999), (9, "u", "q" * 3_000_000)]
    pages = spark.createDataFrame([(*r, b"d", "s") for r in rows], "page_id long, url string, html string, digest binary, seq string")
    a, b = new_folder(spark, "w"), new_folder(spark, "w")
    manifest = warc.write_monolithic(pages, a, roll_bytes=3000)
    out = warc.read_records(warc.normalise(manifest, warc.revisits(manifest), a, b), b).collect()
    assert len(out) == len(rows)
    for page, _, html in rows:
        payload = (html or "").encode()
        assert any((r.page_id, r.payload_bytes, r.payload_digest) == (page, len(payload), hashlib.sha1(payload).hexdigest()) for r in out)
    kinds = {}
    for r in out:
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert kinds[2] == [("response", None)] and kinds[1] == [("revisit", 2)] and kinds[None] == [("revisit", 2)]
    assert sorted(kinds[6], key=str) == [("response", None), ("revisit", 6)]
    assert all(kinds[i] == [("response", None)] for i in (3, 4, 5, 7, 8, 9))
    assert {r.page_id: r.url for r in out}[3] == "http://a/%20b%0A"


def test_streams_of_many_members_and_cut_streams():
    import gzip

    one, two = (warc.page_record(i, "u", b"p" * i, hashlib.sha1(b"p" * i).digest()) for i in (3, 5))
    for packed in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        got = list(warc.records(warc.inflated(packed[i : i + 7] for i in range(0, len(packed), 7))))
        assert [int(h[b"warc-record-id"][10:-1]) for h, _ in got] == [3, 5] and got[1][1].endswith(b"\r\n\r\nppppp")
    with pytest.raises(ValueError):
        list(warc.records([(one + two)[:-10]]))


def test_media_round_trip(spark):
    docs = documents(spark)
    folder = new_folder(spark, "m")
    made = media.store_documents(docs, folder, roll_bytes=1000, remember=2)
    assert made.count() == len(TEXTS)
    places = made.groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("at")).select("digest", "at.*")
    got = {r.digest: r for r in media.read_media(places, folder).collect()}
    for r in made.collect():
        payload = media.padded((TEXTS[r.doc_id] or "").encode())
        m = got[r.digest]
        assert m.payload_sha256 == hashlib.sha256(payload).hexdigest() == r.digest and m.payload_bytes == len(payload)
        assert m.tail_crc32 == zlib.crc32(payload[-16:]) and media.from_png(media.to_png(payload)) == payload
    assert len(media.padded(b"")) == 192 and len(media.padded(b"x" * 192)) == 192 and len(media.padded(b"x" * 193)) == 384


def test_sequences_keep_positions_and_captions(spark):
    html = "<p>one<b> two</b><script>no()</script><figure><img src='sha256:ab' alt='alt'><figcaption>cap &amp; c</figcaption></figure>three<img src='sha256:cd' alt='x'><img src=''><p>four"
    items = media.parse_interleaved(html)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "one two", None, None), (1, "media", None, "ab", "cap & c"), (2, "text", "three", None, None), (3, "media", None, "cd", "x"), (4, "text", "four", None, None)]
    assert media.parse_interleaved(None) == [] and media.parse_interleaved("<<<") != None  # noqa: E711
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<img src=sha256:cd>"), (3, "<img src=sha256:cd>")], "page long, html string")
    store = spark.createDataFrame([("ab", b"1"), ("cd", b"2"), ("ef", b"3")], "digest string, payload binary")
    found = media.resolve(media.interleaved(pages, "page", "html"), store, "page")
    got = sorted((r.page, r.position, bytes(r.payload), r.caption) for r in found.collect() if r.payload is not None)
    assert got == [(1, 1, b"1", "cap & c"), (1, 3, b"2", "x"), (3, 0, b"2", None), (3, 0, b"2", None)]


def test_media_stay_between_their_texts(spark):
    html = "<p>one</p><figure><img src='sha256:aa'><img src='sha256:bb'><figcaption>two of them</figcaption></figure>tail<img src='sha256:aa' alt='again'>"
    pages = spark.createDataFrame([(1, html), (2, "<img src='sha256:bb'>"), (3, "<p>no media</p>"), (4, None), (5, "<p>x</p><img src='http://gone/'>")], "page long, html string")
    payloads = spark.createDataFrame([("aa", 10), ("bb", 20)], "digest string, size int")
    got = sorted((r.page, r.position, r.digest, r.caption, r.before, r.after, r.size) for r in media.resolve(media.interleaved(pages, "page", "html"), payloads, "page").collect())
    assert got == [(1, 1, "aa", "two of them", "one", None, 10), (1, 2, "bb", "two of them", None, "tail", 20), (1, 4, "aa", "again", "tail", None, 10), (2, 0, "bb", None, None, None, 20)]
