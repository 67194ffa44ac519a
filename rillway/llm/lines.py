"""Substring dedup by hashing lines and sentences: of units that repeat anywhere, the earliest ranked occurrence stays.

A text is cut into pieces at line ends, after sentence ends, and before a word in upper case that follows one in lower
case, where a passage pasted into a sentence begins. A unit is a piece with as many of the next (or of the previous)
ones as give it MIN_UNIT characters, so that no unit is so short that it repeats by chance. Units are normalised (lower
case, white space as one blank), their digests are grouped globally, and the earliest occurrence of each is kept. Of
the others, those go that together make a stretch of at least MIN_RUN characters, with their offsets retained: a
stretch of consecutive repeated lines or sentences is a passage, a single short line that recurs isn't.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.staging import discard, numbered, release, stage, tidy, unused, whole_texts
from rillway.llm.windows import Windows, mixed

#: Characters besides white space that a unit has at least (but for a text's last and first units).
MIN_UNIT = 40
#: Characters besides white space that a stretch of repeated units has at least if it goes.
MIN_RUN = 150

WHITE = "\t\n\x0b\x0c\r "
#: What ends a sentence, what may follow it, and what may stand before a word's first letter.
ENDS, CLOSERS, OPENERS = ".!?…:;。！？；", "\"'”’»)]」』）", "\"'“‘«„([¿¡「『（"
#: Ends that need no white space after them.
FULL_WIDTH = "。！？；"


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: bits of what it is (1 white space, 2 end, 4 closer, 8 opener, 16 upper case, 32 full width end), and its lower case."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for bit, some in ((1, WHITE), (2, ENDS), (4, CLOSERS), (8, OPENERS), (32, FULL_WIDTH)):
        kind[[ord(c) for c in some]] |= bit
    for k in range(0x20000):  # no letter beyond has a case
        c = chr(k)
        if unicodedata.category(c) == "Lu":
            kind[k] |= 16
        if len(low := c.lower()) == 1:
            lower[k] = ord(low)
    return kind, lower


class Units:
    """A text's tokens and units. A unit is a range of pieces; piece k begins with token at[k]."""

    def __init__(self, text: str, min_unit: int):
        kind, lower = _kinds()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        what = kind[codes]
        solid = (what & 1) == 0
        begins = solid.copy()
        split = solid[:-1] & ~(((what[:-1] & 32) > 0) & ((what[1:] & (4 | 32)) == 0))
        begins[1:] &= ~split
        self.start = np.flatnonzero(begins)  # of each token
        n = len(self.start)
        self.size = len(text)
        self.first = self.last = np.zeros(0, np.int64)
        if not n:
            return
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | begins[1:]
        self.end = np.flatnonzero(ends) + 1
        lines = np.concatenate([[0], np.cumsum(codes == 10)])
        new_line = lines[self.start[1:]] > lines[self.end[:-1]]
        back = self.end - 1
        for _ in range(2):  # the mark before closing quotes and brackets
            back = np.where(((what[back] & 4) > 0) & (back > self.start), back - 1, back)
        ended = (what[back] & 2) > 0
        letter = np.where(((what[self.start] & 8) > 0) & (self.end - self.start > 1), self.start + 1, self.start)
        upper = (what[letter] & 16) > 0
        piece = np.concatenate([[True], new_line | ended[:-1] | (upper[1:] & ~upper[:-1])])
        at = np.flatnonzero(piece)
        self.at = np.append(at, n)
        solid_before = np.concatenate([[0], np.cumsum(solid)])
        self.held = np.append(solid_before[self.start[at]], solid_before[-1])  # characters before each piece, and all
        m = len(at)
        forward = np.minimum(np.searchsorted(self.held, self.held[:m] + min_unit), m)
        backward = np.maximum(np.searchsorted(self.held, self.held[1:] - min_unit, side="right") - 1, 0)
        pairs = np.unique(np.concatenate([np.arange(m) * (m + 1) + forward, backward * (m + 1) + np.arange(1, m + 1)]))
        self.first, self.last = pairs // (m + 1), pairs % (m + 1)  # pieces from first to before last
        # the normal text: tokens in lower case with a blank before each
        self.place = np.cumsum(solid) - 1 + np.cumsum(begins)
        self.normal = np.full(int(solid.sum()) + n, 32, np.uint32)
        self.normal[self.place[solid]] = lower[codes[solid]]

    def digests(self) -> np.ndarray:
        """A 128-bit digest of each unit, as two longs."""
        if not len(self.first):
            return np.zeros((0, 2), np.int64)
        begin = self.place[self.start[self.at[self.first]]]
        end = self.place[self.end[self.at[self.last] - 1] - 1] + 1
        size = mixed((end - begin).astype(np.uint64))
        return np.stack([(Windows(self.normal, k).of(begin, end) ^ size).view(np.int64) for k in (0, 1)], axis=1)

    def spans(self, repeated: np.ndarray, min_run: int) -> list[tuple[int, int]]:
        """What goes if those units are repeats: begin and end in the text, with the white space after each stretch.

        A stretch that begins a line takes all white space up to the next word, another only what is left of its line.
        """
        a, b = self.first[repeated], self.last[repeated]
        if not len(a):
            return []
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
        a, b = a[new], b[np.append(new[1:], len(b)) - 1]
        long = self.held[b] - self.held[a] >= min_run
        return [(int(self.start[self.at[x]]), int(self.end[self.at[y] - 1]), int(self.start[self.at[y]]) if self.at[y] < len(self.start) else self.size) for x, y in zip(a[long].tolist(), b[long].tolist())]



def cut(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[dict]]:
    """The text without the spans, and the offsets of what was cut: the stretches with the white space that would be left over."""
    out, gone, at = [], [], 0
    for begin, end, following in spans:
        before = begin
        while before and text[before - 1] in " \t\x0b\x0c\r":
            before -= 1
        gap = text[end:following]
        stop = following if not before or text[before - 1] == "\n" or "\n" not in gap else end + gap.index("\n")
        out.append(text[at:begin])
        gone.append({"begin": begin, "end": stop})
        at = stop
    return "".join([*out, text[at:]]), gone


def _units(min_unit: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            docs, numbers, sizes, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [], [np.zeros((0, 2), np.int64)]
            for text in batch.column(2):
                found = Units(text.as_py() or "", min_unit).digests()
                sizes.append(len(found))
                digests.append(found)
            every = np.concatenate(digests)
            unit = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if sizes else np.zeros(0, np.int64)
            columns = [np.repeat(docs, sizes), np.repeat(numbers, sizes), unit.astype(np.int32), np.ascontiguousarray(every[:, 0]), np.ascontiguousarray(every[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "row", "unit", "d1", "d2"])
        tidy()

    return rows


def _cut(names: list[str], text_col: str, spans_col: str, min_unit: int, min_run: int):
    at = names.index(text_col)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, repeated in zip(batch.column(at), batch.column(len(names))):
                text, own = text.as_py(), []
                if text is not None and repeated.is_valid:
                    text, own = cut(text, Units(text, min_unit).spans(np.sort(repeated.values.to_numpy()), min_run))
                texts.append(text)
                spans.append(own)
            columns = [*batch.columns[: len(names)], pa.array(spans, kind)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, spans_col])
        tidy()

    return rows


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, min_unit: int = MIN_UNIT, min_run: int = MIN_RUN) -> DataFrame:
    """docs with each text without the stretches of lines and sentences that earlier ones repeat; rows and other columns stay.

    Earlier is the smaller doc_id (null last), then the higher place in the text. Rows that share an id, or have none,
    are documents of their own in the order of their row numbers, so of rows that repeat one keeps its text. spans_col
    adds what was removed as offsets in the original text (array of begin and end, in code points). Null texts stay
    null, texts without words as they are; a text that is repeated whole becomes empty. Columns of any name stay, but
    for one of the name of spans_col, which is replaced. An empty table stays empty.
    """
    whole_texts(docs.sparkSession)
    docs = docs.drop(spans_col) if spans_col else docs
    names = docs.columns
    doc, row, gone_doc, gone_row, units_col, spans = unused(names, "doc", "row", "gone_doc", "gone_row", "units", "spans")
    own = numbered(docs, id_col, doc, row)
    units = stage(own.select(doc, row, F.col(f"`{text_col}`")).mapInArrow(_units(min_unit), "doc long, row long, unit int, d1 long, d2 long"), "units")
    # staged before the join: so both sides are dealt anew, and a hot unit's places can be split
    first = units.groupBy("d1", "d2").agg(F.min(F.struct("doc", "row", "unit")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stage(first.select("d1", "d2", "first"), "first")
    again = units.join(first, ["d1", "d2"]).where(F.struct("doc", "row", "unit") != F.col("first"))
    gone = stage(again.groupBy(F.col("doc").alias(gone_doc), F.col("row").alias(gone_row)).agg(F.collect_list("unit").alias(units_col)), "repeated")
    discard(units, first)
    joined = own.join(gone, (F.col(doc) == F.col(gone_doc)) & (F.col(row) == F.col(gone_row)), "left").select(*(F.col(f"`{c}`") for c in names), units_col)
    schema = joined.drop(units_col).withColumn(spans, F.lit(None).cast("array<struct<begin:long,end:long>>")).schema
    out = joined.mapInArrow(_cut(names, text_col, spans, min_unit, min_run), schema)
    return out.withColumnRenamed(spans, spans_col) if spans_col else out.drop(spans)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the remaining text, the number of removed stretches and their offsets; nulls, repeats and empty tables as in remove_repeated_lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_lines(docs, spans_col="spans")
    offsets = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_removed"), offsets.alias("removed"))


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "[]\\^-" else c for c in chars).replace("'", "''")


_WS, _FULL, _CLOSE = r"\x20\x09-\x0D", FULL_WIDTH, _class(CLOSERS)
_TOKEN = f"(?:[^{_WS}{_FULL}]|[{_FULL}]+[{_CLOSE}])+[{_FULL}]*|[{_FULL}]+"

OP2_SQL = rf"""
WITH raw AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, text FROM documents),
parts AS (SELECT r, unnest(regexp_extract_all(text, '{_TOKEN}|[{_WS}]+')) AS s, generate_subscripts(regexp_extract_all(text, '{_TOKEN}|[{_WS}]+'), 1) AS i FROM raw),
placed AS (SELECT *, sum(length(s)) OVER (PARTITION BY r ORDER BY i) - length(s) AS b, regexp_matches(s, '^[{_WS}]') AS blank FROM parts),
gaps AS (SELECT *, CASE WHEN lag(blank) OVER o THEN lag(s) OVER o ELSE '' END AS gap_before, CASE WHEN lead(blank) OVER o THEN lead(s) OVER o ELSE '' END AS gap_after FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
tokens AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS t, s, CAST(b AS BIGINT) AS b, CAST(b + length(s) AS BIGINT) AS e, gap_before, gap_after,
         coalesce(sum(length(s)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(length(s)) OVER (PARTITION BY r) AS size,
         regexp_matches(s, '[{_class(ENDS)}][{_CLOSE}]?[{_CLOSE}]?$') AS ended, regexp_matches(s, '^[{_class(OPENERS)}]?\p{{Lu}}') AS upper
  FROM gaps WHERE NOT blank),
flagged AS (
  SELECT *, t = 0 OR contains(gap_before, chr(10)) OR lag(ended) OVER (PARTITION BY r ORDER BY t) OR (upper AND NOT lag(upper) OVER (PARTITION BY r ORDER BY t)) AS starts FROM tokens),
pieces AS (SELECT r, t, b, held, CASE WHEN t = 0 OR contains(gap_before, chr(10)) THEN 1 ELSE 0 END AS line_start, row_number() OVER (PARTITION BY r ORDER BY t) - 1 AS p FROM flagged WHERE starts),
bounds AS (
  SELECT r, t, held, p FROM pieces
  UNION ALL SELECT r, max(t) + 1, any_value(size), (SELECT count(*) FROM pieces x WHERE x.r = f.r) FROM flagged f GROUP BY r),
forward AS (
  SELECT a.r, a.p AS first, coalesce(b.p, l.m) AS last FROM pieces a JOIN (SELECT r, max(p) AS m FROM bounds GROUP BY r) l ON a.r = l.r
  ASOF LEFT JOIN bounds b ON a.r = b.r AND a.held + {MIN_UNIT} <= b.held),
backward AS (
  SELECT a.r, coalesce(b.p, 0) AS first, a.p AS last FROM (SELECT * FROM bounds WHERE p > 0) a ASOF LEFT JOIN bounds b ON a.r = b.r AND a.held - {MIN_UNIT} >= b.held),
units AS (SELECT u.r, u.first, u.last, x.t AS t1, y.t AS t2 FROM (SELECT * FROM forward UNION SELECT * FROM backward) u JOIN bounds x ON u.r = x.r AND u.first = x.p JOIN bounds y ON u.r = y.r AND u.last = y.p),
listed AS (SELECT r, list(s ORDER BY t) AS words FROM tokens GROUP BY r),
named AS (SELECT u.*, lower(array_to_string(words[t1 + 1:t2], ' ')) AS unit FROM units u JOIN listed USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY r, first, last) > 1 AS again FROM named),
runs AS (SELECT *, max(last) OVER (PARTITION BY r ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranked WHERE again),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY first, last) AS run FROM runs),
stretches AS (SELECT r, run, min(t1) AS t1, max(t2) AS t2 FROM numbered GROUP BY r, run),
cuts AS (
  SELECT s.r, a.b AS b, CASE WHEN a.t = 0 OR contains(a.gap_before, chr(10)) OR NOT contains(z.gap_after, chr(10)) THEN z.e + length(z.gap_after) ELSE z.e + strpos(z.gap_after, chr(10)) - 1 END AS e
  FROM stretches s JOIN tokens a ON a.r = s.r AND a.t = s.t1 JOIN tokens z ON z.r = s.r AND z.t = s.t2 - 1
  WHERE z.held + length(z.s) - a.held >= {MIN_RUN}),
sides AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS kept_from, row_number() OVER (PARTITION BY r ORDER BY b DESC) = 1 AS final FROM cuts),
left_over AS (
  SELECT c.r, string_agg(substr(d.text, CAST(kept_from AS BIGINT) + 1, CAST(b - kept_from AS BIGINT)), '' ORDER BY b) || any_value(substr(d.text, CAST(e AS BIGINT) + 1)) FILTER (final) AS text,
         count(*) AS n, string_agg(CAST(b AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY b) AS removed
  FROM sides c JOIN raw d USING (r) GROUP BY c.r)
SELECT d.doc_id, CASE WHEN l.r IS NULL THEN d.text ELSE l.text END AS text, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed, coalesce(l.removed, '') AS removed
FROM raw d LEFT JOIN left_over l USING (r)
"""
