"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z as a-z.  A window is `window`
consecutive words of an item; an item of fewer, but not none, is one window.

1. Postings (term, row, position) of every corpus word that the benchmark has are made in one
   pass over the texts and stored; their counts are the terms' frequencies.
2. Each window is probed by its LISTS rarest terms; neighbouring windows mostly share them.  A
   window with a term that the corpus lacks occurs nowhere.
3. The posting lists of a probe's terms, each moved back by its term's offset in the item, are
   intersected: what all of them hold is an alignment (row, item, shift).
4. The postings of rows that have one are intersected with all words of the item at that shift;
   a run of as many consecutive words as a window has is an exact phrase.
5. Proximity matches, if asked for, are places of a probe's rarest term with most of the words
   around it in the item around it in the row too, in any order.

No occurrence is lost, as it holds all terms of its window; a row's hit words are the union of
its phrases.  Texts are never shuffled, and read once more only to count their words.  The
benchmark's words and probes, and the rows that have an alignment, are broadcast if their bytes,
which are counted, allow it, and are shuffled beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z belong to words, as they count as a-z; letters are folded where words meet.  Written
#: out one by one, letters and digits become one bit table, which is some thirty times as fast as ranges.
WORD = "[0123456789" + _UPPER + _LOWER + r"\x80-\x{10FFFF}]+"
#: Bytes of benchmark words, of probes and of rows' keys up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Posting lists that are intersected for a window, the rarest.
LISTS = 3


def words_of(text) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def folded(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def _bounded(df: DataFrame, size) -> DataFrame:
    """df, marked for broadcast if the sum of its rows' sizes allows it."""
    held = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def _postings(scratch: Scratch, docs: DataFrame, tokens: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings (term, row, pos) of the words of docs that tokens have, terms (word, term)), both stored; row is (id, mark)."""
    terms = scratch.keep(tokens.select("word").distinct().withColumn("term", F.monotonically_increasing_id()).withColumn("key", F.lower("word")))
    rows = docs.select(F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("mark")).alias("row"), words_of(F.col(text)).alias("words"))
    placed = rows.select("row", F.posexplode_outer("words").alias("pos", "own"))  # outer: no filter is inferred that would make the words twice
    met = placed.withColumn("key", F.lower("own")).join(_bounded(terms, F.octet_length("word") + 60), "key").where(folded(F.col("own")) == F.col("word"))
    return scratch.keep(met.select("term", "row", "pos")), terms.select("word", "term")


def _probes(scratch: Scratch, tokens: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(probe, at, size, k, q, term): for each window its rarest terms, the k-th rarest at place q of item at; windows with the same ones are one probe."""
    ranked = tokens.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    width = F.least("length", F.lit(window))
    here = F.collect_list(F.struct("n", "q", "term")).over(W.partitionBy("at").orderBy("q").rowsBetween(0, window - 1))
    rare = ranked.select("at", "q", "length", F.slice(F.sort_array(here), 1, LISTS).alias("rare")).where(F.col("q") + width <= F.col("length"))
    rare = rare.where(F.col("rare")[0]["n"] > 0).select("at", F.transform("rare", lambda x: F.struct(x["q"].alias("q"), x["term"].alias("term"))).alias("rare")).distinct()
    named = scratch.keep(rare.withColumn("probe", F.monotonically_increasing_id()))
    return named.select("probe", "at", F.size("rare").alias("size"), F.posexplode("rare").alias("k", "x")).select("probe", "at", "size", "k", "x.q", "x.term")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, near: float | None = None, item: str = "item_id", item_text: str = "text", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, item, first, last, phrase): places of docs where items occur.

    mark tells texts of equal ids apart.  phrase: the words first to last (counted from 0,
    last not included) are a run of the item of a window's length or more.  With near, a
    share, proximity matches come too (phrase false): first to last span the words within
    window - 1 of a probe's rarest term that are, in any order, at least that share of the
    distinct other words that the item has so near to it.
    """
    scratch = Scratch(docs.sparkSession, "index")
    items = benchmark.select(F.col(item).alias("item"), F.monotonically_increasing_id().alias("at"), folded(F.col(item_text)).alias("t")).select("item", "at", words_of(F.col("t")).alias("words"))
    items = scratch.keep(items)
    plain = items.select("at", F.size("words").alias("length"), F.posexplode("words").alias("q", "word"))
    postings, terms = _postings(scratch, docs, plain, id, text)
    tokens = scratch.keep(plain.join(terms, "word").select("at", "length", "q", "term"))
    counts = scratch.keep(postings.groupBy("term").agg(F.count("*").alias("n")))
    probes = _probes(scratch, tokens, counts, window)
    moved = postings.join(_bounded(probes, F.lit(60)), "term").select("row", "probe", "at", "size", "k", (F.col("pos") - F.col("q")).alias("shift"))
    met = moved.groupBy("row", "probe", "at", "size", "shift").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("lists"))
    aligned = scratch.keep(met.where("lists = shiftleft(1, size) - 1").select("row", "at", "shift").distinct())
    key = F.octet_length(F.coalesce(F.col("row.id").cast("string"), F.lit(""))) + 80
    own = scratch.keep(postings.join(_bounded(aligned.select("row").distinct(), key), "row", "left_semi"))
    wanted = aligned.join(_bounded(tokens, F.lit(60)), "at").select("row", "at", "shift", "length", "q", (F.col("shift") + F.col("q")).alias("pos"), "term")
    held = wanted.join(own, ["row", "pos", "term"]).select("row", "at", "shift", "length", "q").distinct()
    held = held.withColumn("isle", F.col("q") - F.row_number().over(W.partitionBy("row", "at", "shift").orderBy("q")))
    runs = held.groupBy("row", "at", "shift", "length", "isle").agg(F.min("q").alias("q"), F.count("*").alias("m")).where(F.col("m") >= F.least("length", F.lit(window)))
    first = F.col("shift") + F.col("q")
    out = runs.select("row", "at", first.alias("first"), (first + F.col("m").cast("int")).alias("last"), F.lit(True).alias("phrase"))
    if near is not None:
        out = out.unionByName(_proximity(postings, probes, tokens, window, near))
    return out.join(items.select("at", "item"), "at").select("row.id", "row.mark", "item", "first", "last", "phrase")


def _proximity(postings: DataFrame, probes: DataFrame, tokens: DataFrame, window: int, near: float) -> DataFrame:
    """(row, at, first, last, phrase) of the places whose neighbourhood has the share `near` of a probe's neighbourhood."""
    rarest = probes.where("k = 0").select("at", "q", "term").distinct()
    around = rarest.select("at", "q").join(tokens.select("at", F.col("q").alias("o"), F.col("term").alias("other")), "at").where((F.abs(F.col("o") - F.col("q")) < window) & (F.col("o") != F.col("q")))
    around = around.select("at", "q", "other").distinct()
    size = around.groupBy("at", "q").agg(F.count("*").alias("size"))
    places = postings.join(_bounded(rarest, F.lit(60)), "term").select("row", "pos", "at", "q")
    cell = F.floor(F.col("pos") / window).cast("int")
    asked = places.join(_bounded(around, F.lit(60)), ["at", "q"]).withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    there = postings.select("row", F.col("pos").alias("p"), F.col("term").alias("other"), F.floor(F.col("pos") / window).cast("int").alias("cell"))
    found = asked.join(there, ["row", "other", "cell"]).where((F.abs(F.col("p") - F.col("pos")) < window) & (F.col("p") != F.col("pos")))
    got = found.groupBy("row", "at", "q", "pos").agg(F.count_distinct("other").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).join(size, ["at", "q"])
    got = got.where(F.col("n") >= F.lit(near) * F.col("size"))
    return got.select("row", "at", F.least("lo", "pos").alias("first"), (F.greatest("hi", "pos") + 1).alias("last"), F.lit(False).alias("phrase"))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, item: str, item_text: str, id: str, text: str) -> DataFrame:
    found = matches(docs, benchmark, window, None, item, item_text, id, text)
    spans = found.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.collect_set(F.col("item").cast("string")).alias("items"))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    merged = F.aggregate(F.array_sort("spans"), zero, lambda a, s: F.struct(F.greatest(a["upto"], s["last"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["upto"], s["first"]))).alias("n")))
    return checkpointed(spans.select("id", "mark", merged["n"].cast("bigint").alias("n_hit"), F.array_sort("items").alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, part: int = 20, item: str = "item_id", item_text: str = "text", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for every row of docs.

    n_hit: the row's words inside any occurrence of a window; items: the ids, as strings in
    order, of the items whose windows occur; contaminated: n_hit > 0 and part * n_hit >=
    n_words.  Null texts and items have no words; an item whose id is null counts for hits but
    is not listed.  Rows and items may repeat; equal rows get equal results.  An empty
    table gives an empty result; an empty benchmark hits nothing.
    """
    hits = _hits(docs, benchmark, window, item, item_text, id, text).select(F.col("id").alias("i"), F.col("mark").alias("m"), "n_hit", "items")
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    out = rows.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(F.col("id").alias(id), "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n > 0) & (part * n >= F.col("n_words"))).alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = 13, part: int = 20, item: str = "item_id", item_text: str = "text", id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with docs' columns."""
    hits = _hits(docs, benchmark, window, item, item_text, id, text).select(F.col("id").alias("i_"), F.col("mark").alias("m_"), F.col("n_hit").alias("h_"))
    keep = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(id).alias("id_"), F.xxhash64(text).alias("mark_"), F.col(text).alias("text_"))
    out = keep.join(hits, F.col("id_").eqNullSafe(F.col("i_")) & (F.col("mark_") == F.col("m_")), "left")
    bad = F.when(F.col("h_") > 0, part * F.col("h_") >= F.regexp_count("text_", F.lit(WORD))).otherwise(False)
    return out.where(~bad).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
