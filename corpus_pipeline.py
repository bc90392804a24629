"""From raw documents to mixed, encoded training text: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm import bpe, langid, minhash, mix, pii
from loamspark.llm.common import materialize, read

#: A language ID below this score is a rejection, as is a text without letters.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; null texts, texts without letters and unsure ones go.

    Repeated rows share their fate; other columns, whatever their names, pass through; an empty table stays empty.
    """
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = langid.predict(whole, langid.train(docs)).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id.

    Rows without words (null or empty texts) and rows without an id stay; of rows that repeat an id one stays; other columns
    pass through; an empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; n_chars follows the text where it changed.

    Null and empty texts, repeated rows and other columns stay as they are; an empty table stays empty.
    """
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    n = F.when(F.col("text").eqNullSafe(F.col("doc.text")), F.col("doc.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": n}
    return pii.redact(whole).select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Null texts have no words, a null source is a source of its own; other columns pass through; an empty table stays empty.
    """
    return mix.mix_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and digests of the ids and of the bytes they decode to.

    A null text counts as empty; repeated rows stay; other columns are left out; an empty table stays empty.
    """
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decode=True)
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("redact_pii", redact_pii), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: Learned, sampled and drawn decisions have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
