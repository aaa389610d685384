"""Benchmark decontamination (operator 4): a broadcast hash set of test n-grams against every window of every document.

Texts are normalised to words once. The hash set goes to the executors as a bit table of hashes of the windows' first three
words (or fewer, where a window is shorter); a position of a document whose next words are not in it can't begin a hit. For
the few others the whole windows are made as strings and joined with the item windows by equality, which verifies the hit.
Nothing is shuffled before only candidates are left. Results belong to the text, so they're keyed by its digest: null or
repeated doc_ids need no care, and a text that was copied a million times is one group with few distinct hits.

Edge cases: a null or empty text has no words and no hits; an item without words has no window, one with fewer than n words
is a single window; items with a null id hit words but are not named; an empty benchmark leaves all documents clean; a text
of any length is read whole, in steps that grow with its words; equal windows of several items name them all; further
columns of docs are kept by remove_documents and remove_spans, whatever their names (but those that begin with two underscores,
which are the operator's own).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FILE, ROW, ascii_lower, let, placed, small, table, without, written

NGRAM = 10
#: Item windows are broadcast up to this many rows (about 200 MB); beyond it they are joined by a shuffle.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Texts with hits (and the numbers of their hit words) are broadcast up to so many.
MAX_BROADCAST_TEXTS = 100_000
#: Words of a window that the bit table knows, and its size in 64-bit entries (4 million bits).
ANCHOR = 3
TABLE_WORDS = 1 << 16
#: The pipeline removes documents that hold an item window of so many words at least: an item of 1 to 7 words is a phrase
#: that clean documents hold by chance.
MIN_REMOVED_WORDS = 8
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case (A to Z); none for a null text."""
    norm = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD, " "))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _window(w: Column, at: Column, words: Column | int) -> Column:
    return F.array_join(F.slice(w, at + 1, F.lit(words) if isinstance(words, int) else words), " ")


def item_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """window, words (its length), anchor (hash of its first words) and items (ids as strings).

    A window is n consecutive words of an item, or all words of a shorter one.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("words", F.least(F.size("w"), F.lit(n)))
    rows = rows.select("item", "w", "words", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("words"))).alias("at"))
    anchor = F.when(F.col("words") == 1, _anchor(F.col("w"), F.col("at"), 1)).when(F.col("words") == 2, _anchor(F.col("w"), F.col("at"), 2)).otherwise(_anchor(F.col("w"), F.col("at"), ANCHOR))
    return rows.select("item", "words", _window(F.col("w"), F.col("at"), F.col("words")).alias("window"), anchor.alias("anchor")).groupBy("window", "words", "anchor").agg(F.collect_set("item").alias("items"))


def _anchor(w: Column, at: Column, words: int) -> Column:
    """Hash of the words at a position."""
    return F.xxhash64(F.lit(words), *[F.get(w, at + i) for i in range(words)])


def _bit_table(anchors: DataFrame) -> tuple[Column, int]:
    """The bit table of the anchors as a constant column, and their number. It has 512 KB, however many anchors there are."""
    entry, bit = F.pmod("anchor", F.lit(TABLE_WORDS)).cast("int"), F.shiftrightunsigned("anchor", 40).bitwiseAND(F.lit(63)).cast("int")
    rows = anchors.groupBy(entry.alias("entry")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(anchor, 40) & 63 as int))")).alias("bits")).collect()  # TABLE_WORDS rows at most
    bits = np.zeros(TABLE_WORDS, np.int64)
    for r in rows:
        bits[r["entry"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(bits.tolist())), "array<bigint>"), len(rows)


def _in_table(bits: Column, anchor: Column) -> Column:
    return F.getbit(F.get(bits, F.pmod(anchor, F.lit(TABLE_WORDS)).cast("int")), F.shiftrightunsigned(anchor, 40).bitwiseAND(F.lit(63)).cast("int")) == 1


def _candidates(w: Column, lengths: list[int], bits: Column) -> Column:
    """array<struct<at, words, window>>: the windows, of each of these lengths, that may be an item's."""
    none = F.array().cast("array<struct<at:int,words:int,window:string>>")
    kinds = sorted({min(m, ANCHOR) for m in lengths})

    def may(at: Column) -> Column:
        tests = [let(_anchor(w, at, k), lambda a: _in_table(bits, a)) for k in kinds]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    def windows(at: Column) -> Column:
        each = [F.when(at + m <= F.size(w), F.struct(at.alias("at"), F.lit(m).alias("words"), _window(w, at, m).alias("window"))) for m in lengths]
        return F.array(*each)

    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), may)
    return F.when(F.size(w) > 0, F.filter(F.flatten(F.transform(places, windows)), lambda x: x.isNotNull())).otherwise(none)


def scanned(docs: DataFrame, windows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns of every row with digest, n_words and candidates. Texts are read once; windows: of item_windows."""
    lengths = sorted(r["words"] for r in windows.select("words").distinct().collect())  # n values at most
    bits, _ = _bit_table(windows) if lengths else (None, 0)
    rows = docs.select(*keep, F.md5("text").alias("digest"), words_of(F.col("text")).alias("w"))
    found = let(F.col("w"), lambda w: _candidates(w, lengths, bits)) if lengths else F.array().cast("array<struct<at:int,words:int,window:string>>")
    return rows.select(*keep, "digest", F.size("w").cast("long").alias("n_words"), found.alias("candidates"))


def verified(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Every occurrence of an item window in a scanned text: digest, at (first word, from 0), words, items."""
    each = rows.filter(F.col("digest").isNotNull() & (F.size("candidates") > 0)).select("digest", F.explode("candidates").alias("c"))
    each = each.select("digest", "c.at", "c.words", "c.window")
    known = windows.select("window", "words", "items")
    return each.join(F.broadcast(known) if known.count() <= MAX_BROADCAST_WINDOWS else known, ["window", "words"]).select("digest", "at", "words", "items")


def _by_text(hits: DataFrame) -> DataFrame:
    """For each text with a hit: digest, hit_words (their numbers), items (ids), longest (words of the longest window)."""
    hits = hits.groupBy("digest").agg(F.collect_set(F.struct("at", "words")).alias("o"), F.collect_set("items").alias("i"), F.max("words").alias("longest"))
    words = F.array_distinct(F.flatten(F.transform("o", lambda o: F.sequence(o["at"], o["at"] + o["words"] - 1))))
    return hits.select("digest", words.alias("hit_words"), F.array_distinct(F.flatten("i")).alias("items"), "longest")


def text_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Of each text that holds an item window: digest, hit_words, items and longest."""
    windows = written(item_windows(benchmark, n), "item-windows")
    return _by_text(verified(scanned(docs, windows), windows))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    windows = written(item_windows(benchmark, n), "item-windows")
    rows = written(scanned(docs, windows, ("doc_id",)), "scanned")  # no texts, only candidates
    hits = _by_text(verified(rows, windows))
    hits = hits.select("digest", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("ids"))
    hits = written(hits, "text-hits")  # joined by itself, so that a text with very many copies can be split
    found = rows.select("doc_id", "n_words", "digest").join(hits, "digest", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, min_words: int = MIN_REMOVED_WORDS) -> DataFrame:
    """docs without the documents that hold an item window of min_words words or more. Texts are never exchanged."""
    docs, windows = placed(docs), written(item_windows(benchmark, n), "item-windows")
    rows = written(scanned(docs, windows, (FILE, ROW)).filter(F.size("candidates") > 0), "scanned")  # few, without texts
    bad = written(verified(rows, windows).filter(F.col("words") >= min_words).select("digest").distinct(), "bad")
    return without(docs, rows.select("digest", FILE, ROW).join(bad, "digest", "left_semi").select(FILE, ROW))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """docs with the hit words, and what stands before each, cut out of the text; other texts stay as they are."""
    hits = written(text_hits(docs, benchmark, n).select(F.col("digest").alias("__digest"), F.col("hit_words").alias("__hit")), "hits")
    hits = small(hits, MAX_BROADCAST_TEXTS)  # beyond it the join exchanges the documents
    inside, outside = _WORD_ANY_CASE, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    parts = F.regexp_extract_all("text", F.lit(f"({outside}*{inside})"), F.lit(1))
    tail = F.regexp_extract("text", f"({outside}*)$", 1)
    kept = F.filter(parts, lambda p, i: ~F.array_contains("__hit", i))
    cut = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return docs.withColumn("__digest", F.md5("text")).join(hits, "__digest", "left").withColumn("text", cut).select(docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents and the whole benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
OP4_SQL = f"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {NGRAM}) AS m, array_to_string(list_slice(w, i, i + least(len(w), {NGRAM}) - 1), ' ') AS window
  FROM item, unnest(range(1, len(w) - least(len(w), {NGRAM}) + 2)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM win),
hit AS (
  SELECT r, i, d.m, item FROM (
    SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS window FROM doc, sizes, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m) d
  JOIN win ON win.window = d.window AND win.m = d.m),
words AS (SELECT r, count(DISTINCT j) AS n FROM hit, unnest(range(i, i + m)) AS t(j) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
