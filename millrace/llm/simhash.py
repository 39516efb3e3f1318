"""SimHash near-duplicate detection with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bitslice import Labels, link_runs
from millrace.llm.common import cut, small
from millrace.llm.components import components

SEED = 42
#: Rows of one key that are compared in one piece; more are dealt out as pairs of blocks.
BLOCK = 2048
#: Rows that a task compares at a time (whole runs of a key, so one run may exceed it).
BATCH_ROWS = 1 << 16
#: As ``BLOCK``, where shingle sets travel with the rows.
SET_BLOCK = 1024
#: Pairs whose shingle sets are compared before classes are looked at again.
STEP = 512
#: Texts whose shingle sets a task holds at a time.
SET_CHUNK = 512
#: Hashes that are min-hashed together.
KEY_PIECE = 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included; a text with fewer words has one shingle, the whole."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)


def remix(hashes: np.ndarray, turn: int) -> np.ndarray:
    """The hashes themselves for turn 0, else 64 other bits of each (a multiply and xor-shift mixer)."""
    if not turn:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * turn & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Bits that are set in over half the hashes, as big-endian bytes of 8 per word; zero without hashes."""
    out = []
    for turn in range(words):
        counts = np.zeros(64, dtype=np.int64)
        for first in range(0, len(hashes), 8192):
            part = remix(hashes[first : first + 8192], turn).astype(">u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, words: int = 1) -> DataFrame:
    """``id, text_hash, fp`` for every row: the fingerprint of 64 * ``words`` bits as binary."""

    @F.pandas_udf("binary")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, shingle), words) for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"), simhash(F.col(text_col)).alias("fp"))


def exact_keys(radius: int, spare: int = 2) -> Column:
    """Keys of a 64-bit fingerprint such that any two within ``radius`` share one: of radius + spare bands some
    ``spare`` are untouched, whichever bits differ."""
    bands = radius + spare
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    number = F.conv(F.hex("fp"), 16, -10).cast("long")
    keys = []
    for n, chosen in enumerate(combinations(masks, spare)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(n), number.bitwiseAND(F.lit(mask - (mask >> 63 << 64)))))
    return F.array(*keys)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands): keys of sets of hashes, each made of ``rows`` min-hashes.

    Two sets with Jaccard similarity s share a given key with probability s^rows, whatever the size of the corpus, so the
    share of such pairs without a common key is (1 - s^rows)^bands. Keys are 64 bits wide: sets that do not resemble each
    other do not meet.
    """
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros((len(sets), bands), dtype=np.uint64)
    solid = [n for n, x in enumerate(sets) if len(x)]
    ends = np.cumsum([len(sets[n]) for n in solid])
    first = 0
    while first < len(solid):  # pieces that stay in the processor's cache
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + KEY_PIECE, side="right")))
        part = solid[first:last]
        joined, starts = np.concatenate([sets[n] for n in part]), np.r_[0, ends[first : last - 1] - before]
        for band in range(bands):
            key = np.full(len(part), band, dtype=np.uint64)
            for factor in factors[band]:
                key = (key ^ np.minimum.reduceat(joined * factor, starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[part, band] = key
        first = last
    return keys.view(np.int64)


def dealt_out(keyed: DataFrame, row: str, block: int) -> DataFrame:
    """``keyed`` with every ``key`` of over ``block`` rows replaced by one key for each pair of its blocks; ``row`` names a row."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = small(cut(counts.select("key", F.ceil(F.col("n") / block).alias("blocks")), "hot"))
    own = F.pmod(F.xxhash64(F.lit("block"), row), "blocks")
    each = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = keyed.join(hot, "key", "left").select("*", own.alias("own"), F.explode(each).alias("other"))
    pair = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return spread.select(pair.alias("key"), *[c for c in keyed.columns if c != "key"])


def fingerprint_links(rows: DataFrame, radius: int, words: int = 1, block: int = BLOCK) -> DataFrame:
    """``a, b``: for each key, nodes in one class of it and the first node of that class.

    ``rows`` has each ``node`` (binary) once, with its fingerprint ``fp`` and an array ``keys``. Nodes that share a key meet in one task,
    where their fingerprints are compared; those within ``radius`` bits are linked. A key with over ``block`` of them is
    dealt out: its rows fall into blocks by hash, and each pair of blocks is a key of its own.
    """
    keyed = rows.select("node", "fp", F.explode("keys").alias("key"))
    rows = dealt_out(keyed, "node", block).select("key", "node", "fp").repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, nodes, held = np.empty(0, dtype=np.int64), [], np.empty((0, words), dtype=np.uint64)

        def linked(upto):
            row, first = link_runs(held_keys[:upto], held[:upto], radius)
            return pa.RecordBatch.from_arrays([pa.array([nodes[n] for n in at], pa.binary()) for at in (row, first)], names=["a", "b"])

        for batch in batches:
            held_keys = np.r_[held_keys, batch.column(0).to_numpy(zero_copy_only=False)]
            nodes += batch.column(1).to_pylist()
            held = np.concatenate([held, np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, words)])
            if len(held_keys) >= BATCH_ROWS:
                whole = int(np.searchsorted(held_keys, held_keys[-1]))  # the last run may go on
                if whole:
                    yield linked(whole)
                    held_keys, nodes, held = held_keys[whole:], nodes[whole:], held[whole:]
        if len(held_keys):
            yield linked(len(held_keys))

    return rows.mapInArrow(run, "a binary, b binary")


def set_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int, bands: int, rows: int) -> DataFrame:
    """``id, text_hash, fp, sk, keys`` for every row: the fingerprint of the distinct shingles, a 128-bit name of their set,
    and its ``band_keys``."""

    @F.pandas_udf("fp binary, sk binary, keys array<bigint>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        columns = {"fp": [], "sk": [], "keys": []}
        for first in range(0, len(texts), SET_CHUNK):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts.iloc[first : first + SET_CHUNK]]
            columns["fp"] += [fingerprint(x, words) for x in sets]
            columns["sk"] += [set_name(x) for x in sets]
            columns["keys"] += list(band_keys(sets, bands, rows))
        return pd.DataFrame(columns, dtype=object)

    found = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"), prints(F.col(text_col)).alias("p"))
    return found.select("id", "text_hash", "p.fp", "p.sk", "p.keys")


def text_hash(text: str | Column) -> Column:
    return F.xxhash64(F.lit("text"), text)


def set_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def similar_links(fps: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row of its class), for rows not first: classes of rows linked by sets with Jaccard similarity ``least``.

    Every pair within ``radius`` bits is either compared by its sets or already in one class; the nearest come first.
    """
    n = len(sets)
    labels, sizes = Labels(n), np.array([len(x) for x in sets])
    found = []
    for first in range(0, n, 256):
        far = np.bitwise_count(fps[first : first + 256, None, :] ^ fps[None, first:, :]).sum(axis=2, dtype=np.uint16)
        near = far <= radius
        near &= np.minimum(sizes[first : first + 256, None], sizes[None, first:]) >= least * np.maximum(sizes[first : first + 256, None], sizes[None, first:]) - 1e-9
        i, j = np.nonzero(near)
        ahead = j > i
        found.append((i[ahead] + first, j[ahead] + first, far[i[ahead], j[ahead]]))
    i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(far, kind="stable")
    i, j = i[order], j[order]
    at = 0
    while at < len(i):
        apart = labels.of[i[at:]] != labels.of[j[at:]]
        i, j, at = i[at:][apart], j[at:][apart], 0
        same = [jaccard(sets[a], sets[b]) >= least - 1e-9 for a, b in zip(i[:STEP].tolist(), j[:STEP].tolist(), strict=True)]
        labels.join(i[:STEP][same], j[:STEP][same])
        at = STEP
    row = np.flatnonzero(labels.of != np.arange(n))
    return row, labels.of[row]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, each sorted and without repeats."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def verified_links(member: DataFrame, sets: DataFrame, radius: int, least: float, words: int, block: int = SET_BLOCK) -> DataFrame:
    """``a, b``: names of sets in one class of similarity ``least``, among those of one candidate group.

    ``member`` has ``key`` (the group), ``sk`` and ``fp``, ``sets`` the shingle hashes of each ``sk``. A group of over
    ``block`` sets is dealt out as pairs of blocks, so all its pairs meet.
    """
    dealt = dealt_out(member.select("key", "sk"), "sk", block)
    held = member.select("sk", "fp").join(sets, "sk")
    rows = dealt.join(held, "sk").select("key", "sk", "fp", "hashes").repartition("key").sortWithinPartitions("key", "sk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def linked():
            fps = np.frombuffer(b"".join(r[1] for r in held), dtype=np.uint64).reshape(-1, words)
            row, first = similar_links(fps, [np.frombuffer(r[2], dtype=np.uint64) for r in held], radius, least)
            return pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in at], pa.binary()) for at in (row, first)], names=["a", "b"])

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and len(held) > 1:
                    yield linked()
                if k != key:
                    key, held = k, []
                held.append(row)
        if len(held) > 1:
            yield linked()

    return rows.mapInArrow(run, "a binary, b binary")


def similar_groups(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, words: int, bands: int, rows: int, least: float
) -> DataFrame:
    """``id, text_hash, component_id`` for every row, as ``near_groups``, but links are pairs of distinct shingle sets with
    Jaccard similarity ``least`` or more.

    Sets that share one of ``bands`` keys of ``rows`` min-hashes meet, and the bit-sliced comparison of their fingerprints (64 *
    ``words`` bits, of distinct shingles) leaves pairs within ``radius`` bits; sets that are linked so, at any remove, are
    a group, whose sets are compared in full. Texts without words are alike.
    """
    prints = cut(set_prints(docs, id_col, text_col, shingle, words, bands, rows), "fingerprints")
    chosen = [F.min("id").alias("first"), F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys")]
    distinct = cut(prints.groupBy("sk", "fp").agg(*chosen), "distinct")
    roots = components(fingerprint_links(distinct.select(F.col("sk").alias("node"), "fp", "keys"), radius, words))
    found = distinct.join(roots, F.col("sk") == F.col("node"))
    member = cut(found.select("sk", "fp", "text_hash", F.xxhash64("root").alias("key")), "member")
    wanted = small(cut(member.select(F.col("text_hash").alias("wanted")).distinct(), "wanted"))
    texts = docs.join(wanted, text_hash(docs[text_col]) == wanted["wanted"], "left_semi").select(docs[text_col].alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SET_CHUNK):
                found = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(0).slice(first, SET_CHUNK).to_pylist()]
                named = pa.array([set_name(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays(list(named), names=["sk", "hashes"])

    sets = cut(texts.mapInArrow(hashed, "sk binary, hashes binary").groupBy("sk").agg(F.first("hashes").alias("hashes")), "sets")
    roots = components(verified_links(member, sets, radius, least, words))
    rooted = cut(
        distinct.join(roots, F.col("sk") == F.col("node"), "left").select("sk", "first", F.coalesce("root", "sk").alias("root")),
        "rooted",
    )
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = cut(rooted.join(smallest, "root").select("sk", "component_id"), "member")
    return prints.join(named, "sk").select("id", "text_hash", "component_id")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
) -> DataFrame:
    """One row per document: ``id_col, fp, component_id``, the smallest id that is reachable over links, itself included.

    Texts are lower-cased (A-Z only) and split at ASCII white space; shingles of ``shingle`` words, repeats included, are
    hashed by XXH64 to a fingerprint of 64 bits. Fingerprints are linked if they differ in at most ``radius`` bits; the
    search is exact (``exact_keys``).

    Null and empty texts have no words: their fingerprint is zero, and they are linked like any other. Null ids count as
    no id: a component of null ids only has a null id. Rows that repeat an id are all returned. Other columns are
    ignored; an empty table gives none. Copies are merged by fingerprint before anything is compared.
    """
    groups = print_groups(docs, id_col, text_col, shingle, radius)
    return groups.select(F.col("id").alias(id_col), "fp", "component_id")


def print_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``id, text_hash, fp, component_id`` for every row: what ``near_groups`` returns, with the row's text hash."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(fingerprint_links(distinct.select(F.col("fp").alias("node"), "fp", exact_keys(radius).alias("keys")), radius))
    rooted = cut(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")),
        "rooted",
    )
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    member = cut(rooted.join(least, "root").select("fp", "component_id"), "member")
    return prints.join(member, "fp").select("id", "text_hash", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None, **options) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the smallest id.

    With ``least`` documents are linked by the Jaccard similarity of their shingle sets (``similar_groups``), else by
    fingerprints alone (``near_groups``).

    Rows are told apart by id and text hash, so a row that repeats the id of a dropped one stays unless its own text is
    dropped. Rows with a null id stay. Of rows that repeat both id and text one stays; rows that share the id that stays
    but not the text all stay.
    """
    if least is None:
        groups = print_groups(docs, id_col, text_col, **options)
    else:
        groups = similar_groups(docs, id_col, text_col, least=least, **options)
    dropped = small(cut(groups.filter("id <> component_id").select(F.col("id").alias("drop"), F.col("text_hash").alias("drop_hash")), "dropped"))
    same = (docs[id_col] == dropped["drop"]) & (text_hash(docs[text_col]) == dropped["drop_hash"])
    kept = docs.join(dropped, same, "left_anti")
    ids = docs.select(docs[id_col].alias("again")).filter("again IS NOT NULL")
    repeated = cut(ids.groupBy("again").agg(F.count("*").alias("n")).filter("n > 1").select("again"), "repeated")
    if repeated.isEmpty():
        return kept
    again = small(repeated)
    once = kept.join(again, kept[id_col] == again["again"], "left_anti")
    more = kept.join(again, kept[id_col] == again["again"], "left_semi")
    return once.unionByName(more.dropDuplicates([id_col, text_col]))
