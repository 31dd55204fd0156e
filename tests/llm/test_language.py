"""Which languages are learnt from labelled rows."""

import numpy as np

from framewright.llm import language


def test_long_texts_teach_where_none_is_shorter(spark):
    rows = [("der hund und die katze " * 20, "de"), ("le chien et la maison " * 600, "fr"), ("el perro y la casa " * 500, "es"), ("ok", "es")]
    samples = language.labelled_samples(spark.createDataFrame(rows, "text string, lang string"))
    assert set(samples) == {"de", "fr", "es"} and samples["fr"] == rows[1][0].encode() and samples["es"].startswith(b"ok")
    texts = spark.createDataFrame([(0, "la maison et le chien"), (1, "la casa y el perro")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(texts, samples, ["doc_id"]).collect()}
    assert got == {0: "fr", 1: "es"}
    only = language.labelled_samples(spark.createDataFrame(rows[1:2], "text string, lang string"))
    assert set(only) == {"fr"}


def test_every_labelled_language_is_learnt(spark):
    rows = [(f"word{i} text{i} " * 30, f"l{i:03d}") for i in range(230)]
    samples = language.labelled_samples(spark.createDataFrame(rows, "text string, lang string"))
    assert samples == {lang: text.encode() for text, lang in rows}
    many = language.labelled_samples(spark.createDataFrame(rows, "text string, lang string"), all_bytes=1000)
    assert many == samples


def test_whole_texts_up_to_a_number_of_rows(spark):
    texts = [f"text number {i} " * (20 + i) for i in range(60)]
    rows = [(t, "en") for t in texts] + [(texts[0], "en")] * 500
    one = language.labelled_samples(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    parts = one["en"].decode().split("\n")
    assert len(parts) == len(set(parts)) == 16 and set(parts) <= set(texts)
    assert one == language.labelled_samples(spark.createDataFrame(rows, "text string, lang string").repartition(2))
    few = language.labelled_samples(spark.createDataFrame(rows, "text string, lang string"), most_bytes=1000)["en"].decode().split("\n")
    assert few == parts[: len(few)] and sum(map(len, few[:-1])) < 1000 <= sum(map(len, few))


def test_a_very_long_text_teaches_by_passages(spark):
    long = "".join(f"żółw numer {i} płynie. " for i in range(200_000))
    samples = language.labelled_samples(spark.createDataFrame([(long, "pl"), ("a short text " * 20, "en")], "text string, lang string"))
    parts = samples["pl"].decode().split("\n")
    assert len(parts) == 16 and all(p in long for p in parts) and long.startswith(parts[0]) and long.endswith(parts[-1])
    assert 0.9 * 40_000 < len(samples["pl"]) < 1.1 * 40_000 and samples["en"] == b"a short text " * 20
    got = language.identify(spark.createDataFrame([(1, "żółw płynie"), (2, "short text")], "doc_id long, text string"), samples, ["doc_id"])
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "pl", 2: "en"}


def test_automata_are_built_beside_one_table():
    """Building takes the automata's own memory and one language's table, not copies of all."""
    import tracemalloc

    rng = np.random.default_rng(3)
    samples = {f"l{i}": bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8), 8000)) for i in range(8)}
    tracemalloc.start()
    parser = language.CrossParser(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * parser.next.nbytes
