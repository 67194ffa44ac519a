"""Token ids from the tokenizers library, for many texts at a time.

The library spends most of its time on words that it has seen before, and on the objects that it makes for each text.
Both tokenizers used here cut a text between words before anything else. So texts are cut into words and punctuation
with string operations, each distinct piece is encoded once by the library, many at a time, and texts are put
together from the pieces' ids with numpy. A text in which a cut could fall inside one of the library's own pieces is
cut at blanks alone, or goes to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rillway.llm.staging import kept

#: Pieces that a worker remembers; beyond, it keeps those that came up again, half as many at most. That changes no id.
REMEMBERED = 250_000
#: White space besides blanks and line ends, and zero characters.
_RARE = re.compile(r"[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A blank inside a longer run of white space: byte-level words look past it.
_RUN = re.compile(r" (?<=\s )(?:\s|\Z)")
#: Full stops and commas next to other punctuation are one piece with it.
_CLUSTER = re.compile(r"[.,](?:[^\w\s]|_|(?<=[^\w\s][.,])|(?<=_[.,]))")
#: In byte-level pieces they also hold on to white space before them, and line ends to white space around them.
_HELD = re.compile(r"[.,](?:[^\w\s]|_|(?<=\W[.,])|(?<=_[.,])|(?<!.[.,]))")
_BROKEN = re.compile(r"\n(?:\s|\Z|(?<=\s\n)|(?<!.\n))", re.S)


def encoder(path: str, keeps_space: bool, remembered: int = REMEMBERED) -> "Encoder":
    """One encoder for each worker process."""
    return kept(("encoder", path, keeps_space, remembered), lambda: Encoder(path, keeps_space, remembered))


class Encoder:
    """keeps_space: the tokenizer's words carry the blank before them (byte level); else white space is dropped and words end in </w>.

    A piece that begins with a zero character stands for itself without a blank before it.
    """

    def __init__(self, path: str, keeps_space: bool, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # the strings of special tokens are ordinary text in a document
        self.library.no_truncation()
        self.library.no_padding()
        self.keeps_space, self.remembered = keeps_space, remembered
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        #: ids that begin a word (byte level) or end one
        self.edge = np.zeros(self.vocabulary, bool)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            self.edge[k] = token.startswith("\u0120") if keeps_space else token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.first = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.again = np.zeros(1024, np.int32)  # in how many groups of texts a known piece came up
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        """Forgets the pieces that never came up again, and of the others the rarest if they are too many."""
        n = len(self.place)
        again = self.again[:n]
        kept = np.flatnonzero(again)
        if len(kept) > self.remembered // 2:
            kept = np.sort(kept[np.argsort(-again[kept], kind="stable")[: self.remembered // 2]])
        names, size, first, flat, again = list(self.place), self.length[kept], self.first[kept], self.flat, again[kept] // 2
        self._forget()
        m, total = len(kept), int(size.sum())
        ends = np.cumsum(size)
        where = np.repeat(first - (ends - size), size) + np.arange(total)
        self.place = {names[k]: i for i, k in enumerate(kept.tolist())}
        room = 1 << max(10, m.bit_length())
        self.first, self.length, self.again = (np.zeros(room, x.dtype) for x in (self.first, self.length, self.again))
        self.first[:m], self.length[:m], self.again[:m] = ends - size, size, again
        self.flat = np.concatenate([flat[where], np.zeros(4096, np.int32)])
        self.used = total

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = pieces if not self.keeps_space else [x[1:] if x[:1] == "\0" else " " + x for x in pieces]
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone as one text, whose ids tell where each word begins or ends."""
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0].ids, np.int32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(pieces):
            return self._one_by_one(pieces)
        if self.keeps_space:
            return np.diff(np.append(edges, len(ids))), ids
        return np.diff(edges, prepend=-1), ids

    def _learn(self, pieces: list[str]) -> None:
        kinds: tuple[list[str], list[str]] = ([], [])
        for x in pieces:
            kinds[x.isalpha()].append(x)
        for some, encode in zip(kinds, (self._one_by_one, self._words)):
            for at in range(0, len(some), 4000):
                part = some[at : at + 4000]
                sizes, ids = encode(part)
                n = len(self.place)
                while n + len(part) > len(self.first):
                    self.first, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length, self.again))
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, self.flat])
                self.first[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
                self.length[n : n + len(part)] = sizes
                self.flat[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                self.place.update(zip(part, range(n, n + len(part))))

    def _marked(self, text: str) -> str | None:
        """The text with a blank before each piece and a zero before those that have no blank in the text; None if it can't be cut."""
        if not self.keeps_space:
            if not _CLUSTER.search(text):
                text = text.replace(",", " ,").replace(".", " .")
            return text.replace("\n", " ")
        rare = _RARE.search(text)
        if rare and "\0" in text or (rare or "  " in text or "\n " in text or " \n" in text) and _RUN.search(text):
            return None
        if not _HELD.search(text) and not _BROKEN.search(text):
            text = text.replace(",", " \0,").replace(".", " \0.").replace("\n", " \0\n \0")
        return "\0" + text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        marked, cut = [], []
        for k, text in enumerate(texts):
            some = self._marked(text)
            if some is None:
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                marked.append(some)
                cut.append(k)
        if not cut:
            return out
        if len(self.place) > self.remembered:
            self._shrink()
        split = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        counted = split.flatten().dictionary_encode()
        pieces = counted.dictionary.to_pylist()
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.again[at[at >= 0]] += 1
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn([pieces[i] for i in new])
            at[new] = [self.place[pieces[i]] for i in new]
        at = at[counted.indices.to_numpy()]
        size = self.length[at]
        ends = np.cumsum(size)
        where = np.repeat((self.first[at] - (ends - size)).astype(np.int32), size)
        where += np.arange(len(where), dtype=np.int32)
        ids = self.flat[where]
        begin = 0
        for k, stop in zip(cut, ends[split.offsets.to_numpy()[1:] - 1].tolist()):
            out[k] = ids[begin:stop]
            begin = stop
        return out


def larger(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have that many bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def in_groups(texts: list[str | None], most: int = 3_000_000):
    """Index ranges of texts with about that many characters at most; a longer text is alone."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if held and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += n + 1
    if begin < len(texts):
        yield begin, len(texts)
