"""Benchmark decontamination on a distributed positional inverted index, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, small

#: Words of a text whose A-Z have been lower-cased: digits, letters and all beyond ASCII.
WORD_CHARS = r"[0-9a-z\x80-\x{10FFFF}]+"
#: Not a word: its posting closes each document's list, at the number of the document's words.
END = ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; the slower character map runs only where other letters would change."""
    plain = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD_CHARS), F.lit(0))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id, item, length, pos, term`` for every word of every item; equal id and text are one ``item``."""
    words = words_of(F.col(text_col))
    listed = items.select(F.col(item_col).alias("item_id"), words.alias("words")).distinct()
    item = F.xxhash64(F.col("item_id"), F.array_join("words", " "))
    return listed.select("item_id", item.alias("item"), F.size("words").alias("length"), F.posexplode("words").alias("pos", "term"))


def rarest_pairs(terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """For every window of every item its rarest term in the corpus and the next rarest (ties: the earlier position).

    ``item, length, term, pos, next_term, next_pos``, each once; a window of one word has that word twice. An item
    shorter than the window is one window.
    """
    counted = terms.join(counts, "term", "left").withColumn("seen", F.coalesce("n", F.lit(0)))
    last = F.greatest(F.col("length") - window, F.lit(0))
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    starts = F.sequence(F.least(first, last), F.least(F.col("pos"), last))
    spread = counted.select("item", "length", "pos", "term", "seen", F.explode(starts).alias("start"))
    ranked = spread.groupBy("item", "length", "start").agg(F.sort_array(F.collect_set(F.struct("seen", "pos", "term"))).alias("by"))
    rare, then = F.col("by")[0], F.coalesce(F.get("by", F.lit(1)), F.col("by")[0])
    return ranked.select(
        "item", "length", rare["term"].alias("term"), rare["pos"].alias("pos"), then["term"].alias("next_term"), then["pos"].alias("next_pos")
    ).distinct()


def find_phrases(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    slop: int = 3,
) -> dict[str, DataFrame]:
    """Exact phrase and proximity matches of test items in documents.

    Texts are lower-cased (A-Z only); words are runs of digits, letters and characters beyond ASCII. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

    The index holds the postings (document, position, term) of all terms of the items and the length of each document; one pass
    over the texts writes it, and everything else reads it. It gives each term's count; of each window the rarest
    term's postings, less its offset, are the places where the item may begin, and these are intersected with the next
    rarest term's postings, less theirs. In documents that still have places, the lists of all other terms are
    intersected with them in the same way. Runs of at least a window of positions that match exactly are occurrences; runs of
    positions whose term stands within ``slop`` words of its place are proximity matches. Of the lists only those of
    rarest terms, and those of documents that still have places, are shuffled; texts are not.

    Returns ``documents`` (``id_col, text_hash, n_words`` per row), ``exact`` (``id_col, text_hash, item_id, first, last``: runs of
    hit positions, from 0) and ``near`` (``id_col, text_hash, item_id``).

    Null texts have no words; documents are told apart by id and text, so null ids are too; rows that repeat both are one
    document; an item id with several texts has the windows of each. Other columns are ignored; empty tables
    give no matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    doc = ["id", "key", "text_hash"]
    terms = cut(item_terms(items, item_col, item_text_col), "terms")
    item_lists = small(cut(terms.select("item", "pos", "term").distinct(), "items"))
    vocabulary = terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END))).distinct()

    posted = F.posexplode(F.array_append(words_of(F.col("text")), F.lit(END))).alias("at", "term")
    index = cut(source.select(*doc, posted).join(small(cut(vocabulary, "vocabulary")), "term", "left_semi"), "index")
    lengths = index.filter(F.col("term") == END).select(*doc, F.col("at").cast("long").alias("n_words"))
    index = index.filter(F.col("term") != END)
    counts = cut(index.groupBy("term").agg(F.count("*").alias("n")), "counts")
    pairs = small(cut(rarest_pairs(terms, counts, window), "pairs"))
    asked = cut(pairs.select(F.explode(F.array("term", "next_term")).alias("term")).distinct(), "asked")
    rare = index.join(small(asked), "term", "left_semi")

    shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    begins = rare.join(pairs, "term").select(*doc, "item", "length", (F.col("at") - F.col("pos")).alias("place"), "next_term", "next_pos")
    expected = begins.distinct().select("*", (F.col("place") + F.col("next_pos")).alias("expected"))
    met = expected.withColumn("shift", shift).select(
        "key", "text_hash", "item", "length", "place", F.col("next_term").alias("term"), (F.col("expected") + F.col("shift")).alias("at")
    )
    places = cut(
        met.join(rare.select(*doc, "at", "term"), ["key", "text_hash", "at", "term"]).select(*doc, "item", "length", "place").distinct(),
        "places",
    )
    pointed = cut(places.select("key", "text_hash").distinct(), "pointed")
    lists = index.join(small(pointed), ["key", "text_hash"], "left_semi").groupBy("key", "text_hash", "term").agg(F.collect_set("at").alias("ats"))
    wanted = places.join(item_lists, "item").withColumn("at", F.col("place") + F.col("pos"))
    matched = cut(
        wanted.join(cut(lists, "lists"), ["key", "text_hash", "term"])
        .withColumn("hit", F.array_contains("ats", F.col("at")))
        .filter(F.col("hit") | F.exists("ats", lambda x: F.abs(x - F.col("at")) <= slop))
        .select(*doc, "item", "length", "place", "pos", "at", "hit"),
        "matched",
    )
    names = small(cut(terms.select("item", "item_id").distinct(), "names"))
    exact = runs(matched.filter("hit"), doc, window).join(names, "item").select(*doc, "item_id", "first", "last")
    near = runs(matched, doc, window).join(names, "item").select(*doc, "item_id").distinct()
    return {
        "documents": lengths.withColumnRenamed("id", id_col),
        "exact": cut(exact, "exact").withColumnRenamed("id", id_col),
        "near": near.withColumnRenamed("id", id_col),
    }


def runs(matched: DataFrame, doc: list[str], window: int) -> DataFrame:
    """Runs of consecutive item positions of one place that are at least a window (or the whole item) long."""
    order = Window.partitionBy(*doc, "item", "place").orderBy("pos")
    return (
        matched.withColumn("run", F.col("pos") - F.row_number().over(order))
        .groupBy(*doc, "item", "length", "place", "run")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .filter(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("length")))
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated, n_near``.

    ``n_hit`` counts words inside exact occurrences, each once; ``items_sha256`` is of the ids of items with occurrences,
    sorted as strings; ``n_near`` counts items with a proximity match, exact ones included.
    """
    found = find_phrases(docs, items, id_col, **options)
    doc = ["key", "text_hash"]
    # Runs by their start: each adds what lies beyond the farthest end so far.
    before = Window.partitionBy(*doc).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1)))
    fresh = found["exact"].withColumn("fresh", F.greatest(F.col("last") - covered, F.lit(0)))
    hits = fresh.groupBy(*doc).agg(
        F.sum("fresh").cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    near = found["near"].groupBy(*doc).agg(F.count("*").alias("n_near"))
    joined = found["documents"].join(small(cut(hits, "hits")), doc, "left").join(small(cut(near, "near")), doc, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        id_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no item occurs, with all their columns.

    The names of contaminated documents are broadcast while they are few (``small``), else all texts are shuffled once to meet them.
    """
    found = find_phrases(docs, items, id_col, text_col, **options)["exact"]
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    bad = small(cut(found.select("key", "text_hash").distinct(), "bad"))
    return docs.join(bad, (key == bad["key"]) & (F.xxhash64(text) == bad["text_hash"]), "left_anti")
