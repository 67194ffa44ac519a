"""Line-first cleaning and document rules, in DataFrame expressions only.

Each line is judged by itself: how it ends, whether it is a row of links, boilerplate, symbols or shouting. Failing
lines go; a document that loses too much of its text goes with them. Everything happens within a row, so there is no
shuffle, and a long text costs n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.staging import unused, words_pattern

WINDOW = 8
MIN_WORDS = 20
#: Percent of the words that may lie in repeated windows.
MOST_REPEATED = 30
#: Part of a document's characters in words that its good lines must hold.
LEAST_KEPT = 0.5
#: A boilerplate phrase speaks against so many words of its line; a line all of whose words are so accounted for fails.
PHRASE_WORDS = 15
#: A line's symbols, as a part of its characters, beyond which it fails.
MOST_SYMBOLS = 0.1

# Patterns in the syntax that Java and RE2 share; the SQL below uses the same strings.
SYMBOL = r"[#*$%&|<>]"
WHITE = r"[\x20\x09-\x0D]+"
ENDS_WELL = r"""[.!?…:;"'”»)\]][\x20\x09-\x0D]*\z"""
SEPARATOR = r"[|»›·•]"
BOILERPLATE = (
    r"all rights reserved|cookie|privacy policy|terms of (use|service)|enable javascript|click here|subscribe|newsletter"
    r"|sign up|log in|copyright|licensed under|under the mit license|lorem ipsum|read more|share this"
    r"|alle rechte vorbehalten|datenschutz|impressum|hier klicken|abonnieren|weiterlesen"
    r"|tous droits réservés|confidentialité|cliquez ici|abonnez-vous|mentions légales|lire la suite"
    r"|todos los derechos reservados|política de privacidad|haga clic|suscríbase|aviso legal|leer más"
)
LOWER = r"\p{Ll}"
UPPER = r"\p{Lu}"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(words_pattern()), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of that many words that occur twice or more in the array, the first included.

    Windows are compared by 64-bit hashes, all of one text. If some are equal, they are sorted with their places;
    equal neighbours are repeats, and their places, sorted again, say which words they cover.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def places(s: Column) -> Column:
        twin = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bind(by_hash, lambda s: covered(places(s))))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, bind(hashed, lambda w: bind(windows(w), count))).otherwise(F.lit(0).cast("long"))


def plain_length(text: Column) -> Column:
    """Code points outside ASCII white space."""
    return F.length(F.regexp_replace(text, WHITE, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def line_is_good(line: Column) -> Column:
    """Whether a line with a word passes all rules."""
    words = F.regexp_count(line, F.lit(words_pattern()))
    links = (F.regexp_count(line, F.lit(SEPARATOR)) >= 3) & (words <= 6 * F.regexp_count(line, F.lit(SEPARATOR)))
    shouted = ~line.rlike(LOWER) & line.rlike(UPPER) & (words >= 4)
    found = F.regexp_count(F.lower(line), F.lit(BOILERPLATE))
    phrases = (found > 0) & (PHRASE_WORDS * found >= words)
    symbols = (symbol_count(line) > 0) & (symbol_count(line) > F.lit(MOST_SYMBOLS) * plain_length(line))
    return line.rlike(ENDS_WELL) & ~shouted & ~phrases & ~links & ~symbols


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text to every row.

    clean_text is the good lines in their order. A null text has no words and fails; so does an empty one. A column
    of docs that has the name of an added one is replaced. Rows that repeat are judged alike; an empty table stays
    empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = lambda line: line.rlike(words_pattern())
    by_word = bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_line = bind(
        F.filter(F.split(text, "\n"), worded),
        lambda lines: bind(
            F.filter(lines, line_is_good),
            lambda good: F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.array_join(good, "\n").alias("clean_text"), (F.size(good) == F.size(lines)).alias("all_good"),
            ),
        ),
    )
    words, lines = unused(docs.columns, "by_word", "by_line")
    out = docs.withColumns({words: by_word, lines: by_line})
    out = out.withColumns({
        "n_words": F.col(f"{words}.n_words"), "word_chars": F.col(f"{words}.word_chars"), "n_symbols": symbol_count(text), "n_dup_lines": F.col(f"{lines}.n_dup_lines"),
        "n_repeat_words": F.col(f"{words}.n_repeat_words"), "clean_text": F.col(f"{lines}.clean_text"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col(f"{lines}.all_good") | (plain_length(F.col("clean_text")) >= F.lit(LEAST_KEPT) * F.col("word_chars"))))
    return out.drop(words, lines)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's figures and verdict; nulls, empty texts, repeats and empty tables as in judged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WS = r"'[\x20\x09-\x0D]'"
_WORD = _sql_text(words_pattern())
_SYMBOL = _sql_text(SYMBOL)

OP9_SQL = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT r, doc_id, regexp_extract_all(text, {_WORD}) AS words,
         CAST(length(regexp_replace(text, {_WS}, '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, {_SYMBOL}, '', 'g')) AS BIGINT) AS n_symbols
  FROM rows),
windows AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM base)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c >= 2),
covered AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8)) AS n FROM twice) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows) WHERE regexp_matches(line, {_WORD})),
marked AS (
  SELECT r, line, length(regexp_replace(line, {_WS}, '', 'g')) AS chars,
         len(regexp_extract_all(line, {_WORD})) AS words, len(regexp_extract_all(line, {_sql_text(SEPARATOR)})) AS marks,
         len(regexp_extract_all(lower(line), {_sql_text(BOILERPLATE)})) AS phrases,
         length(line) - length(regexp_replace(line, {_SYMBOL}, '', 'g')) AS symbols
  FROM lines),
good AS (
  SELECT r, line, chars,
         regexp_matches(line, {_sql_text(ENDS_WELL)}) AND NOT (phrases > 0 AND {PHRASE_WORDS} * phrases >= words)
         AND NOT (marks >= 3 AND words <= 6 * marks)
         AND NOT (regexp_matches(line, '{UPPER}') AND NOT regexp_matches(line, '{LOWER}') AND words >= 4)
         AND symbols <= {MOST_SYMBOLS} * chars AS ok
  FROM marked),
by_line AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines, sum(CASE WHEN ok THEN chars ELSE 0 END) AS kept_chars FROM good GROUP BY r),
joined AS (
  SELECT b.doc_id, CAST(len(b.words) AS BIGINT) AS n_words, b.word_chars, b.n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(l.kept_chars, 0) AS kept_chars
  FROM base b LEFT JOIN covered c USING (r) LEFT JOIN by_line l USING (r)),
ruled AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_chars >= {LEAST_KEPT} * word_chars AS kept
FROM ruled
"""
