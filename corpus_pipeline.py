"""A corpus pipeline of five operators over ``documents``.

Each stage reads everything its predecessor kept, as Parquet, and its decisions take
effect on the rows; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm import decontam, langid, mixing, setjoin
from matchbook.llm.queries import token_output
from matchbook.session import checkpoint_root


#: Pieces that a worker process remembers in the last stage; the processes of the stages
#: before it still hold their memory then.
TOKEN_CACHE = 120_000


def free_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until none is a column of ``docs`` (names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"{n}_" for n in names)
    return names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no learned language (no letter, no text) go."""
    model = langid.fit(docs.where(~langid.held_out()))
    names = free_names(docs, "lang_pred", "lang_score", "lang_shares")
    return (langid.predict(docs, model, names=names)
            .where(F.col(names[0]) != langid.UNKNOWN).drop(*names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word-shingle similarity >= 0.8 stays."""
    return setjoin.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go; others keep
    their text as it is."""
    names = free_names(docs, "bench_words", "bench_hit", "bench_items", "bench_spans")
    found = decontam.find_contamination(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=names)
    return found.where(~decontam.contaminated(names[1], names[0])).drop(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.take_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    return token_output(docs, cache=TOKEN_CACHE)


STAGES = [("language_id", identify_language), ("jaccard_join", drop_near_duplicates),
          ("decontamination", decontaminate), ("mixing", mix_sources),
          ("token_output", write_tokens)]

#: SQL cannot express the model of the first stage or the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{work}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
