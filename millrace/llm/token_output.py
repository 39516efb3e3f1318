"""Token ids of documents in id order, written in range-coded segments and read back."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, release, setting, small
from millrace.llm.range_coder import decode, encode

#: Tokens after which a segment is closed (at a document's end). The last two of a task are one if they have less than half as many more.
SEGMENT_TOKENS = 1 << 21
#: Words after which a task begins to forget the ones it has not met for as many.
MEMO_WORDS = 75_000
#: Rows in a batch that Spark hands to Python: texts of 1,000 rows take 3 MB where documents are short.
BATCH_ROWS = 1000
#: Texts that are tokenised together.
CHUNK = 512

_SPACE_RUN = re.compile(r"\s ")
#: Marks that end a word as a piece of their own.
_MARKS = ".,;:!?%&#*|)-"


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 16-bit integers."""
    short = array("H", ids)
    if sys.byteorder == "big":
        short.byteswap()
    return short.tobytes()


class Memo(dict):
    """Ids of words (little-endian 16-bit integers), found when first asked for; ``older`` has those of before the last ``age``."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        self.find, self.older = find, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        self[word] = ids = self.find(word) if ids is None else ids
        return ids

    def age(self) -> None:
        """Forget what was not asked for since this was last called."""
        self.older = dict(self)
        self.clear()


class WordEncoder:
    """Encodes texts with a byte-level BPE tokenizer, word by word, remembering words.

    The pre-tokenizer starts a new piece at every space that follows something else than white space, so a text can be
    cut there without changing its ids. Within a word, marks after letters and a single line end between other characters
    are pieces of their own, so letters alone are remembered once for all of their surroundings. Texts with white space before a
    space, or with the string of a special token (which is encoded as that token), are encoded whole.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids must be below 65536")
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        # How byte-level models write bytes: printable ones as themselves, the rest as the characters from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = sorted(set(range(256)).difference(own))
        self.shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.heads, self.words = Memo(lambda w: self.find(w, "")), Memo(lambda w: self.find(w, " "))
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def find(self, word: str, before: str) -> bytes:
        """Ids of one word after ``before``, a space or nothing."""
        if "\n" in word:
            first, *rest = word.split("\n")
            if first and all(rest):
                return self.newline.join([(self.words if before else self.heads)[first], *map(self.heads.__getitem__, rest)])
            return self.whole(before + word)
        if not word.isalpha():
            letters = word.rstrip(_MARKS)
            if not letters.isalpha():
                return self.whole(before + word)
            return (self.words if before else self.heads)[letters] + self.heads[word[len(letters) :]]
        if word.isascii():
            piece = self.shown[32] + word if before else word
        else:
            piece = (before + word).encode().decode("latin-1").translate(self.shown)
        return packed([t.id for t in self.model.tokenize(piece)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        for memo in (self.heads, self.words):
            if len(memo) > MEMO_WORDS:
                memo.age()
        return [self.whole(t) if self.special.search(t) or _SPACE_RUN.search(t) else self.by_words(t.split(" ")) for t in texts]

    def by_words(self, words: list[str]) -> bytes:
        rest = iter(words)
        return self.heads[next(rest)] + b"".join(map(self.words.__getitem__, rest))


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Tokenise every whole text, append ``end_id``, and write all ids in ascending id order under ``path``.

    Spark deals documents out by ranges of their id, each task tokenises and codes its range, and Spark's writer commits the
    files: rows of ``part, segment, ids, counts, n_tokens, data``, where ``data`` is a coded segment and ids and counts name
    its documents. Null text counts as empty; null ids come first; rows with one id go by their text's hash,
    repeated rows stay. Other columns are ignored; an empty table writes no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ordered = source.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = WordEncoder(tokenizer_file), TaskContext.get().partitionId(), 0
        ids, counts, held, total = [], [], [], 0
        id_type = None

        def row(n):
            """The first ``n`` documents held as a segment."""
            tokens = np.frombuffer(b"".join(held[: 2 * n]), dtype="<u2")
            columns = [ids[:n]], [counts[:n]]
            del held[: 2 * n], ids[:n], counts[:n]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array(columns[0], pa.list_(id_type)),
                    pa.array(columns[1], pa.list_(pa.int64())),
                    pa.array([len(tokens)], pa.int64()),
                    pa.array([encode(tokens)], pa.binary()),
                ],
                names=["part", "segment", "ids", "counts", "n_tokens", "data"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for first in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(first, CHUNK)
                for doc, coded in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    counts.append(len(coded) // 2 + 1)
                    held += [coded, end]
                    total += counts[-1]
                    if total >= SEGMENT_TOKENS + SEGMENT_TOKENS // 2:
                        whole = row(1 + int(np.searchsorted(np.cumsum(counts), SEGMENT_TOKENS)))
                        total, segment = sum(counts), segment + 1
                        release()
                        yield whole
        if ids:
            yield row(len(ids))
        del encoder
        release()

    written = ordered.select("id", "text").mapInArrow(
        run, f"part int, segment int, ids array<{kind}>, counts array<bigint>, n_tokens bigint, data binary"
    )
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS):
        written.write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: ``id_col, start, n_tokens, ids_crc32, tokens``.

    ``start`` counts the ids of all documents before it; ``tokens`` are its ids as little-endian unsigned 32-bit
    integers and ``ids_crc32`` their checksum. Every block is checked against its own checksum.
    """
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part, segment, ids, counts, data = (batch.column(k)[at] for k in range(5))
                counts = np.array(counts.as_py(), dtype=np.int64)
                raw = decode(data.as_py()).astype("<u4").tobytes()
                release()
                edges = np.r_[0, np.cumsum(counts)]
                pieces = [raw[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([segment.as_py()] * n, pa.int32()),
                        pa.array(edges[:-1], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                        pa.array(pieces, pa.binary()),
                    ],
                    names=["id", "part", "segment", "offset", "n_tokens", "ids_crc32", "tokens"],
                )

    rows = files.select("part", "segment", "ids", "counts", "data").mapInArrow(
        run,
        f"id {kind}, part int, segment int, offset bigint, n_tokens bigint, ids_crc32 bigint, tokens binary",
    )
    # Tokens before a segment: those of earlier parts, then those of earlier segments of its part.
    sizes = files.select("part", "segment", "n_tokens")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before_part"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("segment"))), F.lit(0))
    base = small(cut(sizes.withColumn("inside", inside).join(parts, "part").select("part", "segment", (F.col("before_part") + F.col("inside")).alias("base")), "base"))
    return rows.join(base, ["part", "segment"]).select(
        F.col("id").alias(id_col), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "tokens"
    )
