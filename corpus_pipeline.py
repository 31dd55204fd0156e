"""The corpus pipeline: toxicity, language, near-duplicates, packing, each stage on what the last one kept."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import base, language, minhash, packing, toxicity
from framewright.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Below this mean phrase length (bytes) a text is no more like any language than noise is. Judged are only
#: texts with so many symbols that the samples have, and no more others: a script that no labelled text has stays.
LEAST_PHRASE, LEAST_KNOWN = 1.5, 20


def staged(stage: Stage) -> Stage:
    """Drop the tables that the stage before has left; its result has been written by then."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        base.release_marked()
        with base.marked():
            return stage(spark, docs, sf_dir)

    return run_stage


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.7; learnt from the labelled ones among them outside the held-out fold.

    A null or empty text has no evidence and stays. Repeated rows are judged each, equal texts alike.
    Without labels of both classes every score is one number: all stay unless most labels are toxic. A text is judged
    whole, however long; all columns come back as they were, whatever their names; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(language.fold(3) != 1).select("doc_id", "text"), labels.where(language.fold(3) != 1), docs.select("text"))
    name = unused(docs, "toxicity")
    return toxicity.score(docs, model, docs.columns, name).where(F.col(name) < 0.7).select(*docs.columns)


@staged
def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: not ``und``, and parsed into longer phrases than noise would be.

    Null and empty texts and texts without a letter are ``und`` and go, and so does every text where no
    labelled row has a language. Repeated rows are judged each, equal texts alike. A text is parsed whole, however long;
    all columns come back as they were, whatever their names; an empty table stays empty.
    """
    samples = language.labelled_samples(docs.where(language.fold(4) != 2).select("text", "lang"))
    names = {c: unused(docs, f"_{c}") for c in language.PREDICTION.names}
    found = language.identify(docs, samples, docs.columns, names)
    lang, phrase, symbols, known = (F.col(names[c]) for c in ("lang_pred", "phrase_length", "symbols", "known"))
    noise = (phrase < LEAST_PHRASE) & (known >= LEAST_KNOWN) & (2 * known >= symbols)
    return found.where((lang != "und") & ~noise).select(*docs.columns)


@staged
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least doc_id.

    Of rows with equal doc_id and text one stays, the least by its columns. Rows of one doc_id with other
    texts are one document and stay together; rows with a null doc_id have no class and all stay. A null
    text is an empty one, and empty texts are copies. Texts are compared whole, however long; all columns come back as
    they were, whatever their names; an empty table stays empty.
    """
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id")
    several = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi")
    if not several.isEmpty():
        again = one.join(several, "doc_id", "left_semi").groupBy("doc_id", base.text_column()).agg(F.min(F.struct(*docs.columns)).alias("_r"))
        one = one.join(several, "doc_id", "left_anti").unionByName(again.select("_r.*"))
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null or empty text is one end token; repeated rows and rows with a null doc_id are packed each. A text is encoded
    whole, however long, and cut only above 2048 tokens; other columns are not looked at; an empty table has no pieces.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: No SQL expresses the models and the packing; tests compare every stage's decisions with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = base.lasting_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
