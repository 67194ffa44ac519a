"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled texts: letters in lower case, and one symbol
for whatever lies between words. A text is cut from left to right into the longest phrases that occur in that sample;
the language whose sample needs the fewest phrases for each symbol wins. The parse is a walk through the automaton
that starts again at its root where no longer match exists, so it is a finite transition table, and numpy walks many
stretches of text through all languages' tables at the same time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.staging import kept, tidy, whole_texts

#: Characters of labelled text for each language that the automata are built from: texts, of longer ones SAMPLE_TEXT
#: characters from the first letter on, by place in a fixed order, until the next would exceed SAMPLE_CHARS.
SAMPLE_CHARS = 60_000
SAMPLE_TEXT = 6_000
#: Rows for each language that the sample is picked from.
SAMPLE_ROWS = 64
#: Characters of all languages' samples together: with more than 8 labels each has less, down to a thousand. A worker's
#: tables take up to 800 bytes for each, so 400 MB.
ALL_CHARS = 480_000
#: Languages that can be learned: the labels of most rows (ties: the first by name), as the samples are bounded.
MOST_LANGUAGES = 480
#: A long text is walked in so many symbols at a time, side by side; where a walk doesn't fall in with that of the text
#: before it within FALL_IN symbols, the text is walked in one.
STRETCH, FALL_IN = 1024, 256
#: Symbols that have a column in the tables; the samples' rarer letters are in sorted lists of transitions.
ALPHABET = 96

#: A letter, for Spark.
_LETTERS = r"\p{L}"
_LETTER = re.compile(r"[^\W\d_]")


def transitions(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton: for each state the next one by symbol; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return go


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """transitions[state, symbol] of the suffix automaton, -1 if none; state 0 is the root."""
    go = transitions(codes)
    out = np.full((len(go), symbols), -1, np.int32)
    for k, some in enumerate(go):
        for c, to in some.items():
            out[k, c] = to
    return out


class Table:
    """One language's parse: the next state, negative (-1 - state) where a phrase begins.

    step[state * dense + symbol] has it for the first symbols; of the others only the transitions that exist are
    kept, by sorted keys, so any number of letters takes memory in proportion to the sample.
    """

    def __init__(self, codes: list[int], dense: int, symbols: int):
        go = transitions(codes)
        self.dense, self.symbols = dense, symbols
        t = np.full((len(go), dense), -1, np.int32)
        rare = []
        for k, some in enumerate(go):
            for c, to in some.items():
                if c < dense:
                    t[k, c] = to
                else:
                    rare.append((k * symbols + c, to))
        del go
        t[:, 0] = -1
        begins = -1 - np.maximum(t[0], 0)
        np.copyto(t, begins, where=t < 0)  # in place, as workers have little memory
        self.step = t.ravel()
        rare.sort()
        self.keys = np.array([k for k, _ in rare], np.int64)
        self.next = np.array([to for _, to in rare], np.int32)
        self.first = np.zeros(symbols, np.int32)  # where a phrase that begins with a rare letter is after it
        at = self.keys < symbols
        self.first[self.keys[at]] = self.next[at]

    def rare(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states by rare letters."""
        out = -1 - self.first[code]
        known = np.flatnonzero(out < -1)
        want = state[known].astype(np.int64) * self.symbols + code[known]
        place = np.searchsorted(self.keys, want)
        hit = place < len(self.keys)
        hit[hit] = self.keys[place[hit]] == want[hit]
        out[known[hit]] = self.next[place[hit]]
        return out


class Languages:
    """The languages' parse tables over one alphabet: every letter of the samples is a symbol."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        self.names = [name for name, _ in samples]
        found: dict[str, int] = {}
        for _, texts in samples:
            for text in texts:
                for ch in filter(str.isalpha, text.lower()):
                    found[ch] = found.get(ch, 0) + 1
        known = sorted(found, key=lambda ch: (-found[ch], ch))
        self.symbols = len(known) + 2  # 0: unseen letter, 1: anything between words
        self.dense = min(self.symbols, ALPHABET)
        self.code = np.fromiter((not chr(k).isalpha() for k in range(0x110000)), np.int32, 0x110000)
        for k, ch in enumerate(known):
            self.code[ord(ch)] = k + 2
        # unseen letters and the ends of texts are where no phrase goes on
        self.tables = [Table([c for text in texts for c in [*self.coded([text])[0].tolist(), 0]], self.dense, self.symbols) for _, texts in samples]

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols one after another, and how many each has: letters in lower case, one symbol for all that lies between words."""
        lowered = [x.lower() for x in texts]
        ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(texts)))
        codes = self.code[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = codes != 1
        keep[1:] |= codes[:-1] != 1
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        keep[begins[begins < len(keep)]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        return codes[keep], kept[ends] - kept[begins]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """phrases[language, text]: how many phrases the language's sample needs for the text's symbols."""
        out = np.zeros((len(self.names), len(texts)), np.int64)
        codes, sizes = self.coded(texts)
        rare = bool((codes >= self.dense).any())
        starts = np.cumsum(sizes) - sizes
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        if not len(owner):
            return out
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + nth * STRETCH
        size = np.minimum(sizes[owner] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(STRETCH), side="left")  # stretches longer than each place

        def follow(table: Table, state: np.ndarray, code: np.ndarray) -> np.ndarray:
            if not rare:
                return table.step[state * self.dense + code]
            far = np.flatnonzero(code >= self.dense)
            to = table.step[state * self.dense + np.where(code < self.dense, code, 0)]
            to[far] = table.rare(state[far], code[far])
            return to

        for k, table in enumerate(self.tables):
            # each stretch by itself, as if a phrase began with it
            counts, ends = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int32)
            for lane in range(0, len(owner), 4096):
                some = order[lane : lane + 4096]
                b, state, count = begin[some], np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
                for at in range(int(size[some[0]])):
                    n = min(len(some), int(alive[at]) - lane)
                    to = follow(table, state[:n], codes[b[:n] + at])
                    new = to < 0
                    count[:n] += new
                    np.copyto(state[:n], np.where(new, -1 - to, to))
                    if at == 0:
                        count[:n] += ~new
                counts[some], ends[some] = count, state
            # then from where the stretch before it ended, beside the first walk, until both are in one state
            at, now, apart_from = 0, np.flatnonzero(nth), np.zeros(len(texts), bool)
            true, alone = ends[now - 1], np.zeros(len(now), np.int32)
            while len(now) and at < FALL_IN:
                code = codes[begin[now] + at]
                to, as_was = follow(table, true, code), follow(table, alone, code)
                counts[now] += (to < 0).astype(np.int64) - (1 if at == 0 else (as_was < 0))
                true, alone = np.where(to < 0, -1 - to, to), np.where(as_was < 0, -1 - as_was, as_was)
                at += 1
                apart = true != alone
                late = apart & (size[now] <= at)  # ended apart
                apart_from[owner[now[late]]] = True
                going = apart & ~late
                now, true, alone = now[going], true[going], alone[going]
            apart_from[owner[now]] = True
            out[k] = np.bincount(owner, counts, len(texts)).astype(np.int64)
            for text in np.flatnonzero(apart_from):
                out[k, text] = self._walked(table, codes[starts[text] : starts[text] + sizes[text]])
        return out

    def _walked(self, table: Table, codes: np.ndarray) -> int:
        """The phrases of one text, symbol by symbol."""
        step, dense, state, count = memoryview(table.step), self.dense, 0, 0
        for c in codes.tolist():
            to = step[state * dense + c] if c < dense else int(table.rare(np.array([state]), np.array([c]))[0])
            if to < 0:
                count += 1
                state = -1 - to
            else:
                count += not count
                state = to
        return count

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """The language, a score from 0 to 1, and the mean length and the number of its phrases.

        The score is the share of phrases that the language saves against the runner-up. Texts without letters are
        und, 0.0, 0.0 and 0.
        """
        out: list[tuple[str, float, float, int]] = [("und", 0.0, 0.0, 0)] * len(texts)
        known = [k for k, x in enumerate(texts) if x and _LETTER.search(x)]
        if not known or not self.names:
            return out
        chosen = [texts[k] for k in known]
        counts = self.phrases(chosen)
        best = np.argmin(counts, axis=0)  # ties: the first name
        least = counts[best, np.arange(len(known))].astype(float)
        second = np.partition(counts, 1, axis=0)[1] if len(self.names) > 1 else np.full(len(known), np.inf)
        score = 1.0 - least / second
        mean = self.coded(chosen)[1] / least
        for k, b, s, m, n in zip(known, best.tolist(), score.tolist(), mean.tolist(), least.astype(int).tolist()):
            out[k] = (self.names[b], s, m, n)
        return out


def usual_phrases(samples: list[tuple[str, list[str]]]) -> dict[str, float]:
    """By language, the median over one half of its sample's texts of the mean phrase that the other half gives.

    One language's tables are held at a time.
    """
    out = {}
    for name, texts in samples:
        if len(texts) == 1:
            middle = len(texts[0]) // 2
            texts = [texts[0][:middle], texts[0][middle:]]
        judged = [mean for lang, _, mean, _ in Languages([(name, texts[::2])]).judge(texts[1::2]) if lang != "und"]
        if judged:
            out[name] = float(np.median(judged))
    return out


def built(samples: list[tuple[str, list[str]]]) -> Languages:
    """The tables, built once in each worker process."""
    key = hash(tuple((name, tuple(texts)) for name, texts in samples))
    return kept(("languages", key), lambda: Languages(samples))


def fold(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[str]]]:
    """The sample of each language, in name order: a few KB each, whatever the size of the table.

    Rows are picked by the hash of their text, so the same table gives the same sample, and copies count once. Only
    counts by language and the picked rows come to the driver. Every language that has a text with letters is learned, of
    more than MOST_LANGUAGES those of most rows: of texts of over SAMPLE_TEXT characters the sample has a stretch. Null
    labels teach nothing.
    """
    lettered = F.regexp_instr(F.col(text_col), F.lit(_LETTERS))
    usable = labelled.where(F.col(lang_col).isNotNull() & (lettered > 0))
    labels = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in labels.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return []
    # about 4 times the rows wanted by a threshold on the hash, then an exact pick: no language is gathered whole
    place = F.xxhash64(F.lit("sample"), F.col(text_col)).bitwiseAND(F.lit((1 << 40) - 1))
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, int(min(1.0, 4 * SAMPLE_ROWS / n) * (1 << 40)))])
    stretch = F.when(F.length(text_col) <= SAMPLE_TEXT, F.col(text_col)).otherwise(F.substring(F.col(text_col), lettered, F.lit(SAMPLE_TEXT)))
    picked = usable.select(F.col(lang_col).alias("lang"), place.alias("place"), stretch.alias("text"))
    some = picked.where(F.col("place") < share[F.col("lang")]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    rows = some.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "text"))), 1, SAMPLE_ROWS).alias("rows")).collect()
    found = {r["lang"]: r["rows"] for r in rows}
    for name in counts.keys() - found.keys():  # its texts are few, so the threshold may miss them all
        found[name] = picked.where(F.col("lang") == F.lit(name)).groupBy("place").agg(F.min("text").alias("text")).orderBy("place").limit(SAMPLE_ROWS).collect()
    out, most = [], max(1000, min(SAMPLE_CHARS, ALL_CHARS // len(found)))
    for name in sorted(found):
        texts, held = [], 0
        for x in dict.fromkeys(r["text"] for r in found[name]):
            if held and held + len(x) > most:
                break
            texts.append(x[:most])
            held += len(x)
        out.append((name, texts))
    return out


def identify(docs: DataFrame, samples: list[tuple[str, list[str]]], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", phrase_cols: tuple[str, str] | None = None) -> DataFrame:
    """Adds the predicted language, its score and, if named, the mean length and the number of its phrases to every row, from its whole text alone.

    Null texts and texts without letters are und with score 0; of languages that need as few phrases the first by name
    wins. Empty tables stay empty; rows that repeat are judged
    alike; all columns of docs stay, but for those that have the new columns' names.
    """
    whole_texts(docs.sparkSession)
    docs = docs.drop(lang_col, score_col, *(phrase_cols or ()))
    added = {lang_col: "", score_col: 0.0} | dict(zip(phrase_cols or (), (0.0, 0)))
    names = [*docs.columns, *added]
    schema = docs.select("*", *(F.lit(v).alias(c) for c, v in added.items())).schema
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rillway.llm.encoding import in_groups

        languages = built(samples)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [x for a, b in in_groups(texts, 500_000) for x in languages.judge(texts[a:b])]
            del texts
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int32())[: len(added)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)
        tidy()

    return docs.mapInArrow(judge, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the rows whose fold is not 2; every row is predicted. Nulls, ties and empty tables as in identify."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = learn(docs.where(fold(F.col("doc_id")) != 2))
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), samples).drop("text")
