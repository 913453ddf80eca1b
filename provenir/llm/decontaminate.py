"""Benchmark decontamination over a positional inverted index, in DataFrame expressions only.

The index holds token postings (term, document, position). Of a benchmark only some terms are looked
up first: for each window of an item, those that are rarest in the corpus are its anchors. Subtracting
an anchor's offset in the item from a posting's position gives the alignment of item and document, and
the lists of an item's anchors are intersected on (document, item, alignment): a window is a candidate
where all anchors inside it are met. A candidate's other words are then looked up in the postings of its
document, position by position, which makes phrase matches exact. Every step is a join or a window over
numbers and terms; no row holds a whole item or the cases of a whole document, and no expression sees a
text twice, whatever a caller filters on.

Broadcasts: tables of the benchmark's terms and windows, if they hold BROADCAST_BYTES at most (else a
shuffled join, whose skewed partitions adaptive execution splits); a bitmap of documents with candidates,
sized by their number up to BITMAP_MOST bits, which keeps other documents' postings out of the second
look-up.

Defined results: null texts have no words; an item without words has no windows; repeated rows are
rows of their own with equal results, null ids among them; an item with a null id is one like any other
and a null at the end of `items`; an empty benchmark hits nothing, an empty corpus gives no rows; only the
named columns are read, so that others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, sized

#: A window's words.
WINDOW = 10
#: Rarest words of a window that are looked up first.
ANCHORS = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the documents' bitmap: so many for each document, between these bounds.
BITMAP_EACH, BITMAP_LEAST, BITMAP_MOST = 16, 1 << 16, 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_between(text: Column) -> Column:
    """The text's words, A-Z in lower case; a separator at either end leaves an empty word there, which matches nothing.

    lower() is three times as fast as translate() and the same for ASCII. For other texts it isn't: it
    follows what stands around a letter (final sigma), beyond the word's ends.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.split(F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER)), SEPARATORS)


def word_count(words: Column) -> Column:
    n = F.size(words)
    return (n - F.when(F.element_at(words, 1) == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is its id and its text, as two hashes: `g` of the id and `h` of the text `t`; repeated rows are one here."""
    d, t = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(d.alias("d"), t.alias("t")).select("d", F.xxhash64(F.col("d").isNull(), "d").alias("g"), F.xxhash64("t").alias("h"), "t")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, among: Column | None = None) -> DataFrame:
    """The index: `term`, `g`, `h` (the document), `pos` (from 0). terms: a table of the only terms to store, in column term, whose rows are joined; among: a condition on h."""
    own = keyed(docs, id_col, text_col)
    found = (own if among is None else own.where(among)).select("g", "h", F.posexplode(words_between(F.col("t"))).alias("pos", "term"))
    # A text that starts with a separator has an empty word there: places shift alike for all of its words.
    return found.where("term <> ''") if terms is None else found.join(sized(terms), "term")


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`key` (of the item's id and words), `item`, `size` (of its windows' words: see windows), `len`, `q` (place from 0), `term`: a row for each word of the distinct items."""
    words = items.select(F.col(id_col).alias("item"), F.filter(words_between(F.col(text_col)), lambda w: w != "").alias("iw")).where("size(iw) > 0").distinct()
    return words.select(F.xxhash64(F.col("item").isNull(), "item", F.array_join("iw", " ")).alias("key"), "item", F.size("iw").alias("len"), F.posexplode("iw").alias("q", "term"))


def anchored(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """`key`, `at`, `size`, `anchors`, `need`: for each window whose words all occur in the corpus its first place, its words, its rarest words' places, and the places of all anchors inside it."""
    size = F.least(F.col("len"), F.lit(window))
    ahead = Window.partitionBy("key").orderBy("q").rowsBetween(0, window - 1)
    ranked = words.join(sized(counts), "term", "left").select("key", "len", "q", F.col("n").isNotNull().alias("known"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q").alias("own"))
    spans = ranked.select("key", "len", "q", F.count_if("known").over(ahead).alias("known"), F.transform(F.slice(F.array_sort(F.collect_list("own").over(ahead)), 1, ANCHORS), lambda x: x.q).alias("anchors"))
    best = spans.where((F.col("q") + size <= F.col("len")) & (F.col("known") == size)).select("key", F.col("q").alias("at"), size.alias("size"), "anchors")
    marks = best.select("key", F.explode("anchors").alias("q")).distinct().withColumn("marked", F.lit(True))
    needs = words.select("key", "q").join(marks, ["key", "q"], "left").select("key", F.col("q").alias("at"), F.collect_list(F.when(F.col("marked"), F.col("q"))).over(ahead).alias("need"))
    return best.join(needs, ["key", "at"])


CASE = ["g", "h", "key", "shift"]


def candidates(docs: DataFrame, words: DataFrame, windows: DataFrame, doc_id: str, doc_text: str, window: int) -> DataFrame:
    """`g`, `h`, `key`, `shift`, `at`, `size`: where in a document (shift + place in the item) a window may stand, by the anchors."""
    lookup = words.join(windows.select("key", F.explode("anchors").alias("q")).distinct(), ["key", "q"]).select("term", "key", "q")
    met = postings(docs, doc_id, doc_text, lookup).select("g", "h", "key", (F.col("pos") - F.col("q")).alias("shift"), "q")
    around = Window.partitionBy(CASE).orderBy("q").rangeBetween(1 - window, window - 1)
    near = met.repartition(*CASE).dropDuplicates([*CASE, "q"]).select(*CASE, "q", F.collect_list("q").over(around).alias("near"))
    own = windows.select("key", F.element_at("anchors", 1).alias("q"), "at", "size", "need")  # met at its rarest word
    return near.join(sized(own), ["key", "q"]).where(F.size(F.array_except("need", "near")) == 0).select(*CASE, "at", "size")


def bitmap(rows: DataFrame) -> Column:
    """A test of column h against the h of rows: true for all of theirs and few others. Its bits grow with rows up to BITMAP_MOST."""
    n = rows.count()
    bits = max(BITMAP_LEAST, min(BITMAP_MOST, 1 << (BITMAP_EACH * max(1, n)).bit_length()))
    place = F.pmod(F.col("h"), F.lit(bits))
    held = bytearray(bits // 8)
    cells = rows.select(F.shiftright(place, 6).alias("k"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    for r in cells.coalesce(1).toLocalIterator():  # a bitmap's words: BITMAP_MOST / 64 at most
        held[r.k * 8 : r.k * 8 + 8] = (r.b & (1 << 64) - 1).to_bytes(8, "little")
    byte = F.conv(F.hex(F.substring(F.lit(bytes(held)), F.shiftright(place, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(F.col("h"), F.lit(8)).cast("int")) == 1


def occurrences(docs: DataFrame, words: DataFrame, found: DataFrame, doc_id: str, doc_text: str, window: int) -> DataFrame:
    """`g`, `h`, `key`, `start`, `end` (words of the document): the stretches that windows of an item cover, from candidates whose every word is looked up."""
    before = F.lag(F.col("at") + F.col("size")).over(Window.partitionBy(CASE).orderBy("at"))
    wanted = found.dropDuplicates([*CASE, "at"]).withColumn("from", F.greatest("at", F.coalesce(before, F.col("at"))))
    places = wanted.select(*CASE, "size", F.explode(F.sequence("from", F.col("at") + F.col("size") - 1)).alias("q"))  # each place of a case once
    asked = places.join(sized(words.select("key", "q", "term")), ["key", "q"]).select(*CASE, "size", "q", (F.col("shift") + F.col("q")).alias("pos"), "term")
    lists = postings(docs, doc_id, doc_text, words.select("term").distinct(), bitmap(found.select("h").distinct())).distinct()
    met = asked.join(lists, ["g", "h", "pos", "term"]).select(*CASE, "size", "q")
    stretch = met.withColumn("run", F.col("q") - F.row_number().over(Window.partitionBy(CASE).orderBy("q")))
    runs = stretch.groupBy(*CASE, "size", "run").agg(F.min("q").alias("q"), F.count("*").cast("int").alias("n")).where("n >= size")
    return runs.select("g", "h", "key", (F.col("shift") + F.col("q")).alias("start"), (F.col("shift") + F.col("q") + F.col("n")).alias("end"))


def document_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """`g`, `h`, `n_hit`, `items` (see phrase_matches) of the documents with hits, written to the shared folder."""
    words = checkpointed(item_words(items, item_id, item_text))
    counts = checkpointed(postings(docs, doc_id, doc_text, words.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n")))
    windows = checkpointed(anchored(words, counts, window))
    found = checkpointed(candidates(docs, words, windows, doc_id, doc_text, window))
    spans = checkpointed(occurrences(docs, words, found, doc_id, doc_text, window))
    reached = F.max("end").over(Window.partitionBy("g", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.select("g", "h", (F.col("end") - F.greatest("start", F.coalesce(reached, F.col("start")))).alias("new"))  # words that no stretch before has
    hits = new.groupBy("g", "h").agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))
    names = words.select("key", F.col("item").cast("string").alias("item")).distinct()
    hit_items = spans.select("g", "h", "key").distinct().join(sized(names), "key").groupBy("g", "h").agg(F.collect_set("item").alias("named"), F.max(F.col("item").isNull()).alias("unnamed"))
    listed = F.concat(F.array_sort("named"), F.when(F.col("unnamed"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    return checkpointed(hits.join(hit_items.select("g", "h", listed.alias("items")), ["g", "h"]))


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, `n_words`, `n_hit` (words inside an occurrence of a window), `items` (sorted ids as strings of the items with one)."""
    per_doc = document_hits(docs, items, doc_id, doc_text, item_id, item_text, window)
    rows = keyed(docs, doc_id, doc_text).select("d", "g", "h", word_count(words_between(F.col("t"))).alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(per_doc, ["g", "h"], "left").select(F.col("d").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, `start`, `end`: a document's spans of at most (distinct words of a phrase + slop) words that hold all of them.

    A span starts at a phrase word and is the shortest from there. Postings of the phrase's words are
    ordered within a document and phrase; each one sees those of the next (words + slop) places alone.
    Repeated rows and phrases give their spans once; null and empty texts give none.
    """
    words = item_words(phrases.select(item_id, F.array_join(F.array_distinct(F.filter(words_between(F.col(item_text)), lambda w: w != "")), " ").alias(item_text)), item_id, item_text)
    uses = words.select("key", "item", "len", "q", "term")
    ids = keyed(docs, doc_id, doc_text).select("d", "g").distinct()
    lists = postings(docs, doc_id, doc_text, uses).select("g", "h", "pos", "key", "item", "len", "q").distinct()
    reach = F.col("len") + slop
    longest = uses.agg(F.coalesce(F.max("len"), F.lit(1)).alias("n")).first().n + slop
    ahead = Window.partitionBy("g", "h", "key").orderBy("pos").rangeBetween(0, longest - 1)
    near = F.filter(F.collect_list(F.struct("pos", "q")).over(ahead), lambda x: x.pos < F.col("pos") + reach)
    seen = lists.select("g", "h", "item", "pos", "len", near.alias("near"))
    ends = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda q: F.array_min(F.transform(F.filter("near", lambda x: x.q == q), lambda x: x.pos)))
    spans = seen.select("g", "item", F.col("pos").alias("start"), ends.alias("ends")).where(F.forall("ends", lambda e: e.isNotNull())).select("g", "item", "start", (F.array_max("ends") + 1).alias("end"))
    return spans.join(ids, "g").select(F.col("d").alias(doc_id), F.col("item").alias(item_id), "start", "end")
