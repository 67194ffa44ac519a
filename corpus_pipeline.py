"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns one row for each piece of a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.staging import discard, stage, unused
from rillway.llm.language import fold, identify, learn, usual_phrases
from rillway.llm.lines import remove_repeated_lines
from rillway.llm.mixing import select_mixed
from rillway.llm.near import first_of_each_class
from rillway.llm.packing import pack_for_training

#: A text whose phrases in its best language are shorter than this on the mean is in none of the learned languages.
LEAST_PHRASE = 1.9
#: A language of many letters has short phrases: there the bound is this share of what its own held-out texts have.
LEAST_SHARE = 0.8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too), or in none of the learned languages, go.

    The bound on a text's mean phrase falls with its number n of phrases, by the factor 1 - 1 / (2 sqrt(n)), as the mean of
    few says little. Rows that repeat are judged alike; without labelled rows no language is known and none stays.
    """
    samples = learn(docs.where(fold(F.col("doc_id")) != 2))
    lang, lead, phrase, n = unused(docs.columns, "lang_pred", "lead", "phrase", "phrases")
    judged = identify(docs, samples, lang_col=lang, score_col=lead, phrase_cols=(phrase, n))
    bounds = {name: min(LEAST_PHRASE, LEAST_SHARE * usual) for name, usual in usual_phrases(samples).items()}
    bound = F.lit(LEAST_PHRASE)
    if bounds:
        bound = F.coalesce(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col(lang)], bound)
    known = F.col(phrase) >= bound * (1 - 0.5 / F.sqrt(F.col(n)))
    return judged.where((F.col(lang) != "und") & known).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the earliest; null texts and texts without words all stay, of rows that repeat one."""
    return first_of_each_class(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of lines and sentences that earlier ones repeat go; every row stays, and n_chars follows the text.

    Null texts stay null, a text that is repeated whole becomes empty; of equal rows the first keeps its text.
    """
    out = remove_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: not at all, once or twice. A null source is a source; texts without words are taken as their hash falls."""
    return select_mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence; a null or empty text is its end id alone, rows that repeat are documents of their own."""
    return pack_for_training(docs, group_chars=500_000, remembered=100_000)  # workers still hold memory of the stages before


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", without_near_copies),
    ("line_dedup", without_repeated_lines),
    ("mix_sources", mixed),
    ("best_fit_packing", packed),
]

#: Language identification, MinHash and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each one's table goes when the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        given, docs = docs, stage(step(spark, docs, sf_dir), name)
        discard(given)
    return docs
