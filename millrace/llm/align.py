"""Alignment of the tokens that two tokenizers make of the same text."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, small
from millrace.llm.token_output import _SPACE_RUN, WordEncoder, packed

#: Characters of texts (or pieces of a longer text) that are tokenised and aligned together.
PIECE_CHARS = 1 << 18
#: Words and windows that a task remembers.
MEMO_WORDS = 200_000
MEMO_WINDOWS = 300_000
#: Distinct id pairs of a task after which their counts are handed on.
TASK_PAIRS = 1_000_000
#: The most frequent id pairs that every task gets; rarer ones are joined.
COMMON_PAIRS = 2_000_000
_ROW_PAIRS = 1 << 16
_MARKS = ".,;:!?%&#*|)-"
#: A space between characters that are no white space: both tokenizers begin a token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class PieceEncoder:
    """Encodes texts with a sentencepiece BPE model, word by word, remembering words.

    No piece of the vocabulary has a space mark behind another character, and BPE only ever joins neighbours, so a text can be cut
    at every single space without changing its ids; likewise at a line end, which no longer piece contains, and between a letter and a
    mark that no piece has in this order. Texts with runs of spaces, or at whose edges a space stands, are encoded whole.
    """

    def __init__(self, model_file: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.model.get_piece_size()
        if size > 1 << 16:
            raise ValueError("token ids must be below 65536")
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = [
            bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        own = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        self.by_space = not any(re.search("[^▁]▁", p) for p in own)
        self.by_line = self.by_space and not any("\n" in p for p in own) and self.ids("\n") == self.ids("\nx")[:2]
        behind = {p[i + 1] for p in own for i in range(len(p) - 1) if p[i].isalpha()}
        self.marks = "".join(m for m in _MARKS if m not in behind) if self.by_line else ""
        self.line = self.ids("\n")
        self.heads, self.words = Generations(self.find_inner), Generations(self.find)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def find_inner(self, text: str) -> bytes:
        """Ids of text that follows a line end or, if it is a run of marks, a letter."""
        return packed(self.ids("\n" + text)[2:])

    def find(self, word: str) -> bytes:
        """Ids of a word with the space before it."""
        if self.by_line and "\n" in word:
            first, *rest = word.split("\n")
            head = self.words[first] if first else packed(self.line[:1])
            return packed(self.line[1:]).join([head, *map(self.heads.__getitem__, rest)])
        letters = self.letters(word)
        if len(letters) < len(word):
            return self.words[letters] + self.heads[word[len(letters) :]]
        return packed(self.ids(word))

    def letters(self, word: str) -> str:
        """The word without the marks at its end if a letter stands before them, else the word."""
        letters = word.rstrip(self.marks) if self.marks else word
        return letters if letters and letters[-1].isalpha() else word

    def learn(self, words: set[str]) -> None:
        """Remember what new words begin with, all in one call of the library."""
        known, older, new = self.words, self.words.older, set()
        for word in words:
            if word not in known and word not in older:
                first = self.letters(word.split("\n", 1)[0] if self.by_line else word)
                if first and first not in known and first not in older:
                    new.add(first)
        known.update(zip(new, map(packed, self.model.encode(list(new), num_threads=1)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        split = [text.split(" ") for text in texts]
        whole = [not self.by_space or "" in words for words in split]
        self.learn(set().union(*(words for words, w in zip(split, whole, strict=True) if not w)))
        return [
            packed(self.ids(text)) if w else b"".join(map(self.words.__getitem__, words)) for text, words, w in zip(texts, split, whole, strict=True)
        ]


def byte_level_tokens(encoder: WordEncoder, size: int) -> list[bytes]:
    """The bytes of every token of a byte-level vocabulary."""
    back = {shown: bytes([b]) for b, shown in encoder.shown.items()}
    return [b"".join(back.get(c, c.encode()) for c in encoder.tokenizer.id_to_token(i) or "") for i in range(size)]


class Generations(dict):
    """What ``find`` gives for a key, found when first asked for; keys not asked for while ``MEMO_WORDS`` others were are forgotten."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        self.find, self.older = find, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        self[key] = ids = self.find(key) if ids is None else ids
        return ids

    def age(self) -> None:
        if len(self) > MEMO_WORDS:
            self.older = dict(self)
            self.clear()


class Windows:
    """Alignments of windows: number of tokens and groups, groups as text, linked pairs. They are remembered by the word that the window is or, in
    texts that are not cut into words, by both id tuples (as bytes of 16-bit integers).

    A group ends where a token of both ends; a pair (``a << 16 | b``) is linked if their byte ranges overlap, once for each such occurrence.
    """

    def __init__(self, a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.a_size, self.b_size = a_size, b_size
        shown = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], dtype=object)
        self.a_inner, self.a_last = shown(len(a_size), ","), shown(len(a_size), "|")
        self.b_inner, self.b_last = shown(len(b_size), ","), shown(len(b_size), ";")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str | tuple[bytes, bytes], int | None] = {}
        self.texts: list[str] = []
        self.n_a, self.n_b, self.groups, self.pairs, self.at = array("q"), array("q"), array("q"), array("I"), array("q", [0])

    def numbers(self, keys: list[tuple[bytes, bytes]]) -> list[int]:
        """A number for each window; those not yet known are aligned together."""
        found, known, fresh, i = list(map(self.known.get, keys)), self.known, [], -1
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            number = known.get(keys[i])
            if number is None:
                number = known[keys[i]] = len(self.texts) + len(fresh)
                fresh.append(keys[i])
            found[i] = number
        if fresh:
            self.align(fresh)
        return found

    def align(self, keys: list[tuple[bytes, bytes]]) -> None:
        a, b = (np.frombuffer(b"".join(k[side] for k in keys), "<u2").astype(np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(k[side]) // 2 for k in keys]) for side in (0, 1))
        self.n_a.extend(n_a.tolist())
        self.n_b.extend(n_b.tolist())
        # Windows one after another: both sides' tokens tile the same bytes, and every window's end is an end of both.
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        window = np.repeat(np.arange(len(keys)), n_a)
        self.groups.extend(np.bincount(window[np.searchsorted(a_end, shared)], minlength=len(keys)).tolist())

        first, last = np.searchsorted(b_end, a_end - self.a_size[a], "right"), np.searchsorted(b_end - self.b_size[b], a_end)
        links = last - first
        inside = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        self.pairs.frombytes((np.repeat(a, links) << 16 | b[np.repeat(first, links) + inside]).astype(np.uint32).tobytes())
        self.at.extend((self.at[-1] + np.cumsum(np.bincount(window, weights=links, minlength=len(keys)).astype(np.int64))).tolist())

        # A group's A tokens, then its B tokens.
        in_a, in_b = (np.cumsum(np.bincount(g, minlength=len(shared))) for g in (a_group, b_group))
        text = np.empty(len(a) + len(b), dtype=object)
        ends = lambda group: np.r_[group[1:] != group[:-1], True]
        text[np.arange(len(a)) + np.r_[0, in_b][a_group]] = np.where(ends(a_group), self.a_last[a], self.a_inner[a])
        text[np.arange(len(b)) + in_a[b_group]] = np.where(ends(b_group), self.b_last[b], self.b_inner[b])
        text, edge = text.tolist(), np.r_[0, np.cumsum(n_a + n_b)].tolist()
        self.texts += ["".join(text[i:j])[:-1] for i, j in zip(edge[:-1], edge[1:], strict=True)]


class Aligner:
    """Aligns documents; a document longer than ``PIECE_CHARS`` goes in pieces cut where both tokenizers begin a token."""

    def __init__(self, byte_bpe_file: str, piece_model_file: str) -> None:
        self.a, self.b = WordEncoder(byte_bpe_file), PieceEncoder(piece_model_file)
        self.a.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.a.special = re.compile(r"(?!)")
        self.a_bytes = byte_level_tokens(self.a, self.a.tokenizer.get_vocab_size())
        self.a_size, self.b_size = (np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b.bytes))
        self.a_space, self.b_space = (np.array([t.startswith(b" ") for t in tokens]) for tokens in (self.a_bytes, self.b.bytes))
        self.a_flat, self.b_flat = ((np.frombuffer(b"".join(t), np.uint8), np.cumsum(n) - n, n) for t, n in ((self.a_bytes, self.a_size), (self.b.bytes, self.b_size)))
        self.windows = Windows(self.a_size, self.b_size)

        self.a.heads, self.a.words = (Generations(m.find) for m in (self.a.heads, self.a.words))

    def encode_a(self, text: str) -> bytes:
        return self.a.whole(" " + text) if _SPACE_RUN.search(" " + text) else self.a.by_words(["", *text.split(" ")])

    @staticmethod
    def same(coded: list[bytes], flat: tuple[np.ndarray, np.ndarray, np.ndarray], want: list[bytes]) -> list[bool]:
        """For each text whether its tokens' bytes, one after another, are the wanted ones; ``flat`` has all tokens' bytes, starts and sizes."""
        data, start, size = flat
        ids = np.frombuffer(b"".join(coded), "<u2")
        sizes = size[ids]
        end = np.cumsum(sizes)
        got = data[np.repeat(start[ids] - (end - sizes), sizes) + np.arange(end[-1] if len(end) else 0)].tobytes()
        edge = np.r_[0, end][np.r_[0, np.cumsum([len(c) // 2 for c in coded])]].tolist()
        return [got[i:j] == w for i, j, w in zip(edge[:-1], edge[1:], want, strict=True)]

    def split(self, text: str) -> Iterator[str]:
        first = 0
        while len(text) - first > PIECE_CHARS and (m := _CUT.search(text, first + PIECE_CHARS)):
            yield text[first : m.start()]
            first = m.start() + 1
        yield text[first:]

    def pieces(self, texts: list[str]) -> list[list[int] | None]:
        """The windows of each piece (a text, or part of one that begins after a space); None if the tokens' bytes are not those of a
        space and the text.

        In a text without white space before a space or an edge of the text that is a space, both tokenizers begin a token at every space and
        nowhere else at one, so its words are its windows.
        """
        split = [text.split(" ") for text in texts]
        whole = [not self.b.by_space or "" in words or bool(_SPACE_RUN.search(text)) for text, words in zip(texts, split, strict=True)]
        self.learn(set().union(*(words for words, w in zip(split, whole, strict=True) if not w)))
        known, rest = self.windows.known, iter(self.cut([text for text, w in zip(texts, whole, strict=True) if w]))
        found = [next(rest) if w else list(map(known.__getitem__, words)) for words, w in zip(split, whole, strict=True)]
        return [None if numbers is None or None in numbers else numbers for numbers in found]

    def learn(self, words: set[str]) -> None:
        """Align new words; one whose tokens' bytes are not its own gets None for a number."""
        new = list(words.difference(self.windows.known))
        if not new:
            return
        self.b.learn(set(new))
        # Of words, letters alone are remembered by the tokenizers, too: other words may begin with them.
        a = [self.a.words[w] if w.isalpha() else self.a.find(w, " ") for w in new]
        b = [self.b.words[w] if w.isalpha() else self.b.find(w) for w in new]
        want = [b" " + w.encode() for w in new]
        good = [x and y for x, y in zip(self.same(a, self.a_flat, want), self.same(b, self.b_flat, want), strict=True)]
        number = count(len(self.windows.texts))
        self.windows.known.update((w, next(number) if ok else None) for w, ok in zip(new, good, strict=True))
        if any(good):
            self.windows.align([k for k, ok in zip(zip(a, b, strict=True), good, strict=True) if ok])

    def cut(self, texts: list[str]) -> list[list[int] | None]:
        """The windows of texts that are tokenised whole.

        All texts are tokenised first. Both token sequences tile the same bytes, so a shared start of two tokens is a shared end of the
        tokens before; where both tokens there begin with a space, a window ends.
        """
        if not texts:
            return []
        a, b, want = list(map(self.encode_a, texts)), self.b.encode(texts), [b" " + t.encode() for t in texts]
        good = [x and y for x, y in zip(self.same(a, self.a_flat, want), self.same(b, self.b_flat, want), strict=True)]
        kept, found = [(x, y) if ok else None for x, y, ok in zip(a, b, good, strict=True)], []
        a_all, b_all = b"".join(k[0] for k in kept if k), b"".join(k[1] for k in kept if k)
        a_ids, b_ids = np.frombuffer(a_all, "<u2"), np.frombuffer(b_all, "<u2")
        a_start, b_start = np.cumsum(self.a_size[a_ids]) - self.a_size[a_ids], np.cumsum(self.b_size[b_ids]) - self.b_size[b_ids]
        begins = np.zeros(int(self.a_size[a_ids].sum()) + 1, dtype=bool)
        begins[a_start[self.a_space[a_ids]]] = True
        b_begins = b_start[self.b_space[b_ids]]
        shared = b_begins[begins[b_begins]]
        # Offsets of the windows in the ids' bytes; each text begins with a space, so its start is among them.
        a_at, b_at = (np.r_[np.searchsorted(s, shared), len(s)] * 2 for s in (a_start, b_start))
        cuts = lambda ids, at: [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        numbers = self.windows.numbers(list(zip(cuts(a_all, a_at.tolist()), cuts(b_all, b_at.tolist()), strict=True)))
        edge = np.searchsorted(a_at, np.cumsum([len(k[0]) if k else 0 for k in kept])).tolist()
        for k, i, j in zip(kept, [0, *edge[:-1]], edge, strict=True):
            found.append(numbers[i:j] if k else None)
        return found

    def documents(self, rows: Iterator[tuple[object, str | None]]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]]:
        """Aligned documents some at a time: ``(id, n_a, n_b, n_groups, sha256)`` of each, and for all of them the offsets of each one's
        distinct pairs, the pairs and how many links each has in that document."""
        held, chars = [], 0
        for row in rows:
            held.append(row)
            chars += len(row[1] or "")
            if chars >= PIECE_CHARS:
                yield self.together(held)
                held, chars = [], 0
        if held:
            yield self.together(held)

    def together(self, rows: list[tuple[object, str | None]]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        if len(self.windows.texts) > MEMO_WINDOWS:
            self.windows.clear()
        for memo in (self.a.heads, self.a.words, self.b.heads, self.b.words):
            memo.age()
        w, owner, piece = self.windows, [], []
        for at, (_, text) in enumerate(rows):
            if text:
                for part in self.split(text):
                    owner.append(at)
                    piece.append(part)
        bad, shas = np.zeros(len(rows), dtype=bool), [None] * len(rows)
        doc, window = [], []
        first = 0
        for last in self.batches(piece):
            for at, one in zip(owner[first:last], self.pieces(piece[first:last]), strict=True):
                if one is None or bad[at]:
                    bad[at] = True
                    continue
                text = ";".join(map(w.texts.__getitem__, one)).encode()
                if shas[at]:
                    shas[at].update(b";" + text)
                else:
                    shas[at] = hashlib.sha256(text)
                doc.append(np.full(len(one), at, dtype=np.int64))
                window.append(np.array(one, dtype=np.int64))
            first = last
        doc, window = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (doc, window))
        good = ~bad[doc]
        doc, window = doc[good], window[good]
        sums = ((np.bincount(doc, weights=np.frombuffer(v, np.int64)[window], minlength=len(rows)) if len(window) else np.zeros(len(rows))) for v in (w.n_a, w.n_b, w.groups))
        n_a, n_b, groups = (total.astype(np.int64).tolist() for total in sums)
        at, pairs = np.frombuffer(w.at, np.int64), np.frombuffer(w.pairs, np.uint32)
        # Distinct windows of a document, then the pairs of each, then distinct pairs of the document.
        both, times = np.unique(doc << 32 | window, return_counts=True)
        doc, window = both >> 32, both & 0xFFFFFFFF
        length = at[window + 1] - at[window]
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        key = np.repeat(doc, length).astype(np.uint64) << np.uint64(32) | pairs[np.repeat(at[window], length) + inside]
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, length)[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        links = np.add.reduceat(times, start) if len(start) else times
        key = key[start]
        edge = np.searchsorted(key >> np.uint64(32), np.arange(len(rows) + 1, dtype=np.uint64))
        out = [(row[0], n_a[i], n_b[i], groups[i], shas[i].hexdigest()) if shas[i] and not bad[i] else (row[0], 0, 0, 0, "") for i, row in enumerate(rows)]
        return out, edge, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), links

    @staticmethod
    def batches(pieces: list[str]) -> Iterator[int]:
        """Ends of runs of pieces of about ``PIECE_CHARS`` characters."""
        total = 0
        for i, piece in enumerate(pieces):
            total += len(piece)
            if total >= PIECE_CHARS or i == len(pieces) - 1:
                yield i + 1
                total = 0


def _lists(edge: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, kind))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, back, np.concatenate(counts))
    return key, total


def align(
    docs: DataFrame, byte_bpe_file: str, piece_model_file: str, id_col: str = "doc_id", text_col: str = "text", common_pairs: int = COMMON_PAIRS
) -> DataFrame:
    """How a byte-level BPE (A, on a space and the text) and a sentencepiece BPE (B, which adds the space itself) cut each whole text:
    ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per document.

    Both tokenise the whole text, special tokens' strings as plain text. Where tokens of both end before tokens that begin with a space, the
    document is cut into windows of token ids; a window's alignment is remembered by its two id tuples. ``groups_sha256`` is over
    ``a1,a2|b1;a3|b2,b3``. A link is a pair of occurrences whose bytes overlap; an id pair's count is its number of links in all
    documents; ``n_best`` are the links whose pair has its B id's highest count, ``count_sum`` adds up their counts.

    Documents go through Python once. Pair counts are added up in each task first and then by Spark; they grow with the vocabularies, not
    with the corpus. The most frequent pairs (``common_pairs`` at most, which is what bounds the broadcast) are looked up by each task;
    links of rarer ones, if there are any, are joined, which meets no hot key. Neither changes the result.

    A null or empty text, or one whose tokens' bytes are not those of a space and the text, has zeros and an empty ``groups_sha256``.
    Rows that repeat an id stay apart; null ids stay null; other columns are ignored; an empty table gives no rows. A text of any length
    goes in pieces cut at single spaces, so a task holds one piece's arrays; a run without such a space is one piece.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task, number, keys, counts, id_type = None, TaskContext.get().partitionId(), 0, [], [], None

        def emit(ids, columns, edge, key, count):
            arrays = [pa.array(ids, id_type), *columns, _lists(edge, key.astype(np.uint32).view(np.int32), pa.int32()), _lists(edge, count, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "links"])

        def totals(key, count):
            edge = np.r_[np.arange(0, len(key), _ROW_PAIRS), len(key)]
            n, types = len(edge) - 1, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return emit([None] * n, [pa.nulls(n, t) for t in types], edge, key, count)

        for batch in batches:
            id_type = batch.schema.field(0).type
            aligner = aligner or Aligner(byte_bpe_file, piece_model_file)
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for out, edge, key, count in aligner.documents(rows):
                ids, n_a, n_b, n_groups, sha = zip(*out, strict=True)
                row = pa.array((task << 40) + number + np.arange(len(ids)), pa.int64())
                number += len(ids)
                yield emit(ids, [row, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(sha)], edge, key, count)
                keys.append(key)
                counts.append(count)
                if sum(map(len, keys)) > TASK_PAIRS:
                    key, count = _merge(keys, counts)
                    keys, counts = [key], [count]
                    if len(key) > TASK_PAIRS // 2:
                        yield totals(key, count)
                        keys, counts = [], []
        if keys:
            yield totals(*_merge(keys, counts))

    schema = f"id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<int>, links array<bigint>"
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "aligned")

    sums = rows.filter("row IS NULL").select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("p.pairs", "p.links")
    counted = cut(sums.groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("total")), "pairs")
    b_id = F.col("pair").bitwiseAND(0xFFFF)
    highest = cut(counted.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest")), "highest")
    marked = counted.withColumn("b", b_id).join(small(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    least = _least_common(counted, common_pairs)
    common = marked.filter(F.col("total") >= least).toArrow() if least else marked.limit(0).toArrow()
    keys = common.column("pair").to_numpy().view(np.uint32) if common.num_rows else np.zeros(0, np.uint32)
    order = np.argsort(keys)
    known = docs.sparkSession.sparkContext.broadcast(
        (keys[order], common.column("total").to_numpy()[order].astype(np.int64), common.column("best").to_numpy(zero_copy_only=False)[order].astype(bool))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total, best = known.value
        for batch in batches:
            pairs, links = batch.column("pairs"), batch.column("links")
            key, n = pairs.flatten().to_numpy(zero_copy_only=False).view(np.uint32), links.flatten().to_numpy(zero_copy_only=False)
            edge = np.r_[0, np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))]
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
            worth, top = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
            worth[hit], top[hit] = total[at[hit]], best[at[hit]]
            add = lambda v, edge=edge: np.diff(np.r_[0, np.cumsum(v)][edge])
            rest = np.r_[0, np.cumsum(~hit)][edge]
            columns = [pa.array(add(v), pa.int64()) for v in (n, n * top, n * worth)]
            columns += [_lists(rest, key[~hit].view(np.int32), pa.int32()), _lists(rest, n[~hit], pa.int64())]
            kept = [batch.column(c) for c in ("id", "row", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*schema_names[:6], "n_links", "n_best", "count_sum", "pairs", "links"])

    schema_names = ["id", "row", "n_a", "n_b", "n_groups", "groups_sha256"]
    looked = rows.filter("row IS NOT NULL").mapInArrow(
        look_up, f"id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint, pairs array<int>, links array<bigint>"
    )
    if counted.count() > common.num_rows:
        looked = cut(looked, "looked")
        rare = looked.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("n"))
        extra = rare.join(marked.filter(F.col("total") < least) if least else marked, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("total")).alias("more_sum")
        )
        looked = looked.join(extra, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
        )
    return looked.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _least_common(counted: DataFrame, most: int) -> int | None:
    """The least power of two such that at most ``most`` pairs have that count; None if there is none."""
    power = F.floor(F.log2("total") + 1e-9).cast("int")
    sizes = dict(counted.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect())
    least, total = None, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > most:
            break
        least = 1 << p
    return least
