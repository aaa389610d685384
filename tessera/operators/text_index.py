"""Term projection and lexical search. The index is a DataFrame of exploded tokens; search is an equi-join on the token."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalog import shared_root, small, written
from tessera.functions.text import contains, normalise, search_tokens
from tessera.sources.published import newest, publish


#: Query tokens are broadcast up to so many rows; beyond it index and queries meet by a shuffle.
MAX_BROADCAST_TOKENS = 100_000


def field_values(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, field and value (normalised) of each named field that isn't empty."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in fields.items()]))
    return rows.select(key, pairs.alias("v")).select(key, "v.field", normalise(F.col("v.value")).alias("value")).filter("value <> ''")


def term_projection(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, field, value_digest and token: a row for each token of each named field. A full, deterministic rebuild.

    The value itself stays behind: a token row only has its digest, so the index grows with the tokens, not their square.
    """
    values = field_values(rows, key, fields).select(key, "field", F.md5("value").alias("value_digest"), search_tokens(F.col("value")).alias("tokens"))
    return values.select(key, "field", "value_digest", F.explode("tokens").alias("token"))


#: Query tokens that a scan looks for without an index; with more of them the index is built.
MAX_SCAN_TOKENS = 500


def query_projection(rows: DataFrame, key: str, fields: dict[str, str], queries: DataFrame) -> DataFrame:
    """The rows of term_projection whose token is one of the queries', without making the others.

    For a few tokens it's cheaper to look for each in the text than to make all of a text's tokens: a bigram is held where
    the text without white space contains it, a word among the text's words, a whole value where it equals the text.
    """
    rows_wanted = queries.select(F.explode(search_tokens(F.col("text"))).alias("token")).distinct().limit(MAX_SCAN_TOKENS + 1).collect()
    tokens = sorted(r["token"] for r in rows_wanted)
    if len(tokens) > MAX_SCAN_TOKENS:
        return term_projection(rows, key, fields)
    pairs = [t for t in tokens if len(t) == 2 and " " not in t]
    others = [t for t in tokens if t not in pairs]
    literal = lambda ts: F.array(*[F.lit(t) for t in ts]).cast("array<string>")
    values = field_values(rows, key, fields).withColumn("bare", F.regexp_replace("value", r"\s", ""))
    held = [F.filter(literal(pairs), lambda t: F.contains(F.col("bare"), t)), F.array_intersect(F.regexp_extract_all("value", F.lit("[a-zA-Z0-9]+"), F.lit(0)), literal(others)), F.filter(literal(others), lambda t: t == F.col("value"))]
    return values.select(key, "field", F.md5("value").alias("value_digest"), F.explode(F.array_distinct(F.concat(*held))).alias("token"))


def token_match(index: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """query, key and score: an index row that holds a query token adds 1, a field equal to the whole query 2 more.

    queries: query_id and text. Their tokens are counted; a small set is broadcast, so the index isn't shuffled before it is
    reduced to hits.
    """
    wanted = queries.select("query_id", F.md5(normalise(F.col("text"))).alias("whole"), F.explode(search_tokens(F.col("text"))).alias("token"))
    hits = index.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_TOKENS else wanted.hint("merge"), "token")
    exact = F.max((F.col("value_digest") == F.col("whole")).cast("int"))
    return hits.groupBy("query_id", key).agg((F.count(F.lit(1)) + 2 * exact).cast("double").alias("raw_score"))


#: Directories over which a stored index is dealt by token, and tasks that share one's rows (a frequent token has one for each row).
INDEX_BUCKETS = 64
INDEX_SHARE = 4
#: Tokens longer than this (whole values) are stored by their digest.
LONGEST_TOKEN = 64


def _stored_token(token: Column) -> Column:
    return F.when(F.length(token) > LONGEST_TOKEN, F.concat(F.lit("md5:"), F.md5(token))).otherwise(token)


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(INDEX_BUCKETS)).cast("int")


def store_index(rows: DataFrame, key: str, fields: dict[str, str], path: str) -> None:
    """The term projection, written once: a directory for each bucket of tokens, sorted by token, for queries to read a little of."""
    terms = term_projection(rows, key, fields).withColumn("token", _stored_token(F.col("token"))).withColumn("bucket", _bucket(F.col("token")))
    dealt = terms.repartition(INDEX_BUCKETS, "bucket", F.pmod(F.xxhash64(key), F.lit(INDEX_SHARE))).sortWithinPartitions("bucket", "token")
    dealt.write.partitionBy("bucket").parquet(path)


def stored_projection(spark: SparkSession, path: str, key_type: str, key: str, queries: DataFrame) -> DataFrame:
    """The rows of a stored index for the queries' tokens: buckets are pruned, and row groups by their tokens' range."""
    asked = queries.select(F.explode(search_tokens(F.col("text"))).alias("token")).distinct().select("token", _stored_token(F.col("token")).alias("stored"))
    found = asked.withColumn("bucket", _bucket(F.col("stored"))).limit(MAX_SCAN_TOKENS + 1).collect()
    index = spark.read.schema(f"{key} {key_type}, field string, value_digest string, token string, bucket int").parquet(path)
    if len(found) <= MAX_SCAN_TOKENS:
        index = index.filter(F.col("bucket").isin(sorted({r["bucket"] for r in found})) & F.col("token").isin([r["stored"] for r in found]))
    names = asked.select(F.col("stored").alias("token"), F.col("token").alias("__token"))
    return index.join(F.broadcast(names) if len(found) <= MAX_SCAN_TOKENS else names, "token").withColumn("token", F.col("__token")).select(key, "field", "value_digest", "token")


def index_of(spark: SparkSession, source: str, rows: DataFrame, key: str, fields: dict[str, str]) -> str:
    """Where the stored index of a source's rows lies; it is made if there is none for the source's files as they are."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "length", "modificationTime").collect()
    state = "|".join(sorted(f"{r['path']}:{r['length']}:{r['modificationTime']}" for r in listed)) + f"|{key}|{sorted(fields.items())}"
    base = f"{shared_root(spark)}/term-index-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    done = newest(spark, base)
    if done is None:  # written to a folder of its own and published last: a lost driver leaves nothing in the way
        folder = f"v-{uuid.uuid4().hex}"
        store_index(rows, key, fields, f"{base}/{folder}")
        publish(spark, base, {"number": 0, "folder": folder})
        done = newest(spark, base)
    return f"{base}/{done['folder']}"


# --- phrases, and an index that is kept up by document ------------------------------------------------------------------

#: Segments of an index before they are made one.
MAX_SEGMENTS = 16


def words_in_order(text: Column) -> Column:
    """The runs of letters and digits of a normalised text, in order: what a phrase is a row of."""
    return F.regexp_extract_all(normalise(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """token, key, field and places: where each word of each named field stands, from 0."""
    each = field_values(rows, key, fields).select(key, "field", F.posexplode(words_in_order(F.col("value"))).alias("at", "token"))
    return each.groupBy("token", key, "field").agg(F.array_sort(F.collect_list("at")).alias("places"))


def phrase_hits(index: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """query_id, key, field and at: every place where a query's words (query_id, text) stand one after another in a field.

    A word's place less its place in the phrase is where the phrase would begin; it does where all its words say so. The
    queries' words are counted and broadcast, so only postings of these words are shuffled, and once.
    """
    asked = queries.select("query_id", F.posexplode(words_in_order(F.col("text"))).alias("offset", "token"), F.size(words_in_order(F.col("text"))).alias("__n"))
    asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST_TOKENS else asked
    found = index.join(asked, "token").select("query_id", key, "field", "__n", "offset", F.explode("places").alias("place"))
    begins = found.groupBy("query_id", key, "field", (F.col("place") - F.col("offset")).alias("at"), "__n").agg(F.count(F.lit(1)).alias("n"))
    return begins.filter((F.col("n") == F.col("__n")) & (F.col("at") >= 0)).select("query_id", key, "field", "at")


class PhraseIndex:
    """Stored postings that are kept up by document.

    A segment holds the postings of the documents that came with it, by bucket of token, and a table of those documents. A
    document's postings count if no later segment names it, so one that comes again replaces itself, and one that is
    removed comes with nothing. The manifest is written last. Many segments are made one.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    @classmethod
    def build(cls, rows: DataFrame, key: str, fields: dict[str, str], path: str) -> PhraseIndex:
        spark = rows.sparkSession
        number = (newest(spark, path) or {"number": -1})["number"] + 1
        empty = cls(spark, path, {"number": number, "key": key, "key_type": rows.schema[key].dataType.simpleString(), "fields": fields, "segments": []})
        return empty._with(postings(rows, key, fields), rows.select(key))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PhraseIndex:
        found = newest(spark, path)
        if not found:
            raise ValueError(f"no_manifest: {path}")
        return cls(spark, path, found)

    def refresh(self, rows: DataFrame) -> PhraseIndex:
        """With these documents as they are now, new ones and changed ones."""
        return self._with(postings(rows, self.manifest["key"], self.manifest["fields"]), rows.select(self.manifest["key"]))

    def remove(self, keys: DataFrame) -> PhraseIndex:
        return self._with(self.live().limit(0), keys.select(self.manifest["key"]))

    def _with(self, terms: DataFrame, keys: DataFrame) -> PhraseIndex:
        folder = f"segment-{uuid.uuid4().hex}"
        key = self.manifest["key"]
        dealt = terms.select("token", key, "field", "places", _bucket(F.col("token")).alias("bucket"))
        dealt = dealt.repartition(INDEX_BUCKETS, "bucket", F.pmod(F.xxhash64(key), F.lit(INDEX_SHARE))).sortWithinPartitions("bucket", "token")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{folder}/terms")
        keys.distinct().write.parquet(f"{self.path}/{folder}/documents")
        after = self.manifest | {"number": self.manifest["number"] + 1, "segments": [*self.manifest["segments"], folder]}
        out = PhraseIndex(self.spark, self.path, publish(self.spark, self.path, after))
        return out.compacted() if len(after["segments"]) > MAX_SEGMENTS else out

    def compacted(self) -> PhraseIndex:
        """One segment of what counts."""
        terms = written(self.live(), "postings")
        return PhraseIndex(self.spark, self.path, self.manifest | {"segments": []})._with(terms, terms.select(self.manifest["key"]))

    def live(self, buckets: list[int] | None = None) -> DataFrame:
        """The postings that count; of these buckets only (None: of all)."""
        key, parts, later = self.manifest["key"], [], None
        for folder in reversed(self.manifest["segments"]):
            rows = self.spark.read.schema(f"token string, {key} {self.manifest['key_type']}, field string, places array<int>, bucket int").parquet(f"{self.path}/{folder}/terms")
            rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
            parts.append((rows if later is None else rows.join(small(later), key, "left_anti")).select("token", key, "field", "places"))
            own = self.spark.read.schema(f"{key} {self.manifest['key_type']}").parquet(f"{self.path}/{folder}/documents")
            later = own if later is None else later.unionByName(own)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def phrases(self, queries: DataFrame) -> DataFrame:
        """phrase_hits() of the queries; only the buckets of their words are read where these are few."""
        tokens = queries.select(F.explode(words_in_order(F.col("text"))).alias("token")).select(_bucket(F.col("token")).alias("b")).distinct()
        return phrase_hits(self.live(sorted(r["b"] for r in tokens.collect())), self.manifest["key"], queries)  # INDEX_BUCKETS rows at most


def lexical_hits(index: DataFrame, key: str, surfaces: DataFrame, k: int) -> DataFrame:
    """The top k of each query over its surfaces (query_id, surface_no, text): scores summed, the first surface that hit named."""
    numbered = surfaces.select(F.concat_ws("|", F.col("query_id").cast("string"), F.col("surface_no").cast("string")).alias("query_id"), F.col("query_id").alias("q"), "surface_no", "text")
    scored = token_match(index, key, numbered).join(numbered, "query_id").groupBy("q", key).agg(F.sum("raw_score").alias("raw_score"), F.min_by("text", "surface_no").alias("matched_text"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("raw_score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("q", "query_id")


def like_search(values: DataFrame, key: str, field: str, needle: str) -> DataFrame:
    """Keys of which the named field (of field_values) contains the needle."""
    return values.filter((F.col("field") == field) & contains(F.col("value"), F.lit(needle))).select(key).distinct()


def conversation_search(messages: DataFrame, query: str, k: int) -> DataFrame:
    """The k newest messages that hold every word of the query; where none does, those that contain it as a string.

    Both are taken in one plan: by string only where no message holds the words.
    """
    words = search_words(query)
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    by_word = F.size(F.array_intersect(held, F.array(*[F.lit(w) for w in words]))) == len(set(words)) if words else F.lit(False)
    found = messages.withColumn("__w", F.coalesce(by_word, F.lit(False))).filter(F.col("__w") | contains(F.col("text"), F.lit(query)))
    top = found.orderBy(F.desc("__w"), F.desc("conv_id"), F.desc("turn")).limit(k)
    return top.withColumn("__any", F.max("__w").over(W.partitionBy())).filter(F.col("__w") == F.col("__any")).drop("__w", "__any")  # k rows


def search_words(query: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", query.lower())


def recent_history(messages: DataFrame, conversations: int, each: int) -> DataFrame:
    """The last messages of the most recent conversations, oldest first within one."""
    recent = messages.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(conversations)
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.join(recent, "conv_id", "left_semi").withColumn("from_end", last).filter(F.col("from_end") <= each)


def surfaces(spark: SparkSession, rows: list[tuple[int, int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, surface_no int, text string")
