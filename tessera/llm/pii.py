r"""Personal data (operator 5): protected entities by pattern, then terms that disclose them, by corpus co-occurrence.

Entities are emails, IP addresses, card and phone numbers. Around each mention lies a context. Over the whole corpus,
a term t of the contexts of an entity c discloses of c's information

    D(c, t) = PMI(c; t) / IC(c) = log(N * n(c, t) / (n(c) * df(t))) / log(N / n(c))

with all four counted over distinct texts (so copies of a document count once): N all, n(c) those that hold the entity,
n(c, t) those that hold the term in one of its contexts, and df those that hold the term. D is 1 where the term tells the
entity outright and about 0 for words that stand anywhere. Where at least MIN_SUPPORT distinct contexts agree, a term with D >= REMOVE is removed from the entity's contexts, one with D >= GENERALISE is generalised.

All matching runs in the JVM: a split by the pattern gives the stretches between matches and so, by their lengths, the
offsets. The patterns start only where a run of their characters starts (or the last match ended) and never give back what
they took, which keeps them linear on texts of any length and changes no match.

Offsets are running sums over the matches; arrays are only ever appended to within runs of STEP, as an append copies what is
there. Contexts are cut from pieces of PIECE characters, as a cut at a far offset walks all that is before it.

Edge cases: a null text is an empty one; nulls and repeats of doc_id need no care, as spans belong to the text (by its
digest); a text may hold any number of spans and have any length; a term that two entities disclose counts with the stronger
disclosure; equal starts are ordered by kind; further columns of docs are kept by sanitised, whatever their names (but
`__digest` and `__cuts`, which are its own); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FILE, ROW, let, placed, table, without, written

KINDS = ("email", "ip", "card", "phone", "term")
_OCTETS = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9]){_OCTETS}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{10}", "phone": r"\+[0-9]"}
#: Characters on either side of an entity that make up its context.
CONTEXT = 80
#: Emails before and after a place that can reach into a context there: none is shorter than five characters, and they don't overlap.
BESIDE = CONTEXT // 5 + 2
MIN_SUPPORT = 2
GENERALISE, REMOVE = 0.75, 0.9
#: Terms and (entity, term) pairs are broadcast up to so many rows; beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
_TERM = r"\p{L}{3,}"
#: Elements of a run of appends, and characters of a piece of text.
STEP = 128
PIECE = 2048


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(12, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _folded(items: Column, zero: Column, step, out_type: str) -> Column:
    """All that step appends: fold items with (state, appended array), in runs of STEP so that no append copies much.

    step(state, item) gives struct<state, add>, add being an array to append.
    """
    none = F.array().cast(out_type)

    def run(state: Column, part: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["add"]).alias("out")))

        return F.aggregate(part, F.struct(state.alias("state"), none.alias("out")), one)

    def whole(xs: Column) -> Column:
        def each(acc: Column, i: Column) -> Column:
            return let(run(acc["state"], F.slice(xs, i * STEP + 1, F.lit(STEP))), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        runs = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STEP).cast("int"))
        folded = F.aggregate(runs, F.struct(zero.alias("state"), F.array().cast(f"array<{out_type}>").alias("out")), each)
        return F.when(F.size(xs) > 0, F.flatten(folded["out"])).otherwise(none)

    return let(items, whole)


def _offsets(text: Column, pattern: str, valid) -> Column:
    """array<struct<start, stop, value>> of the valid matches; code points, stop exclusive.

    One pass over (stretch before a match, match) pairs; only valid matches are appended.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))

    def step(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        stop = start + F.coalesce(F.length(x["value"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))
        good = x["value"].isNotNull() & valid(x["value"])
        return F.struct(stop.alias("state"), F.when(good, found).otherwise(F.array().cast(_FOUND)).alias("add"))

    return _folded(pairs, F.lit(0), step, _FOUND)


_FOUND = "array<struct<start:int,stop:int,value:string>>"
_SPAN = "array<struct<start:int,k:int,stop:int,value:string>>"


def _base(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    none = F.array().cast(_SPAN)

    def spans(k: int, kind: str) -> Column:
        found = _offsets(text, PATTERNS[kind], lambda m: _valid(kind, m))
        named = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["stop"].alias("stop"), s["value"].alias("value")))
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINT[kind])
        return F.when(hint, named).otherwise(none)

    return F.array_sort(F.concat(*[spans(k, kind) for k, kind in enumerate(PATTERNS)]))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, n: Column) -> Column:
    """At most PIECE characters from start on, from a text's pieces."""
    i = F.floor(start / PIECE).cast("int")
    return F.substr(F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit(""))), start - i * PIECE + 1, n)


def base_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest (of the text) and base: the spans of each row, with their contexts; and the kept columns. Texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *keep, text.alias("text"), F.md5(text).alias("digest")).withColumn("base", _base(F.col("text")))

    def around(mails: Column, before: Column, pieces: Column):
        def one(s: Column, i: Column) -> Column:
            # Emails have letters that are no terms. They are found by their place among all emails, however many other spans
            # lie between: no span has two of them begin inside it.
            beside = F.slice(mails, F.greatest(F.get(before, i) - BESIDE, F.lit(0)) + 1, F.lit(2 * BESIDE))
            emails = F.filter(beside, lambda b: (b["start"] < s["stop"] + CONTEXT) & (s["start"] - CONTEXT < b["stop"]))
            places = F.transform(emails, lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop")))
            left = _cut(pieces, F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["start"], F.lit(CONTEXT)))
            return F.struct(s["start"].alias("start"), s["k"].alias("k"), s["stop"].alias("stop"), s["value"].alias("value"), left.alias("left"), _cut(pieces, s["stop"], F.lit(CONTEXT)).alias("right"), places.alias("emails"))

        return one

    def counted(n: Column, s: Column) -> Column:
        """How many emails begin before a span, or with it."""
        return let(n + F.when(s["k"] == 0, 1).otherwise(0), lambda m: F.struct(m.alias("state"), F.array(m).alias("add")))

    def all_around(base: Column) -> Column:
        mails, before = F.filter(base, lambda b: b["k"] == 0), _folded(base, F.lit(0), counted, "array<int>")
        return let(mails, lambda m: let(before, lambda n: let(_pieces(F.col("text")), lambda pieces: F.transform(base, around(m, n, pieces)))))

    spans_ = let(F.col("base"), all_around)
    none = F.array().cast("array<struct<start:int,k:int,stop:int,value:string,left:string,right:string,emails:array<struct<start:int,stop:int>>>>")
    return rows.select("doc_id", *keep, "digest", F.when(F.size("base") > 0, spans_).otherwise(none).alias("base"))


def _terms(context: Column, begins: Column, cut_first: Column, cut_last: Column) -> Column:
    """Terms of a context with their places; a word that the context's edge may have cut is left out."""
    all_terms = F.transform(_offsets(context, _TERM, lambda m: F.lit(True)), lambda t: F.struct(F.lower(t["value"]).alias("term"), (t["start"] + begins).alias("start"), (t["stop"] + begins).alias("stop")))
    return F.filter(all_terms, lambda t: ~(cut_first & (t["start"] == begins)) & ~(cut_last & (t["stop"] == begins + F.length(context))))


def _mentions(rows: DataFrame) -> DataFrame:
    """Per distinct text and entity mention: digest, entity, context, terms (with places outside base spans)."""
    texts = rows.filter(F.size("base") > 0).select("digest", "base").dropDuplicates(["digest"])
    each = texts.select("digest", F.explode("base").alias("s"))
    terms = F.concat(
        _terms(F.col("s.left"), F.col("s.start") - F.length("s.left"), F.length("s.left") == CONTEXT, F.lit(False)),
        _terms(F.col("s.right"), F.col("s.stop"), F.lit(False), F.length("s.right") == CONTEXT),
    )
    free = F.filter(terms, lambda t: ~F.exists("s.emails", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return each.select("digest", F.concat_ws(":", F.col("s.k").cast("string"), F.lower("s.value")).alias("entity"), F.xxhash64("s.left", "s.right").alias("context"), free.alias("terms"))


def disclosures(texts: DataFrame, mentions: DataFrame, n_texts: int) -> DataFrame:
    """entity, term and d of the pairs that at least MIN_SUPPORT distinct contexts hold and that disclose GENERALISE or more.

    texts: every text once, and how many there are.
    """
    per_entity = mentions.select("entity", "digest").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    each = mentions.select("entity", "digest", "context", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    pairs = each.groupBy("entity", "term").agg(F.count_distinct("digest").alias("n_ct"), F.count_distinct("context").alias("support"))
    pairs = written(pairs.filter(F.col("support") >= MIN_SUPPORT).drop("support").join(per_entity, "entity"), "pairs")
    wanted = written(pairs.select("term").distinct(), "terms")
    # How many distinct texts hold each of those terms.
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))).alias("term"))
    kept = words.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_ROWS else wanted, "term")
    df = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(float(n_texts))
    pmi = F.log(n * F.col("n_ct") / (F.col("n_c") * F.col("df")))
    ic = F.log(n / F.col("n_c"))
    d = F.when(ic > 0, F.least(F.lit(1.0), pmi / ic))
    return pairs.join(df, "term").select("entity", "term", d.alias("d")).filter(F.col("d") >= GENERALISE)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base and terms (array of start, stop, remove) of every row of docs."""
    docs = placed(docs)
    rows = written(base_spans(docs, (FILE, ROW)), "base-spans")
    mentions = written(_mentions(rows), "mentions")
    # Each text once, where it lies first: the places of the others are sent to the documents, whose texts are not exchanged.
    first = written(rows.groupBy("digest").agg(F.min(F.struct(FILE, ROW)).alias("x")).select(f"x.{FILE}", f"x.{ROW}"), "first-texts")
    texts = without(docs.select("text", FILE, ROW), rows.select(FILE, ROW).join(first, [FILE, ROW], "left_anti"))
    found = written(disclosures(texts, mentions, first.count()), "disclosures")
    rows = rows.drop(FILE, ROW)
    if found.count() <= MAX_BROADCAST_ROWS:
        found = F.broadcast(found)
    each = mentions.select("digest", "entity", F.explode("terms").alias("t")).select("digest", "entity", F.col("t.term").alias("term"), F.col("t.start").alias("start"), F.col("t.stop").alias("stop"))
    hit = each.join(found, ["entity", "term"]).groupBy("digest", "start", "stop").agg(F.max(F.col("d") >= REMOVE).alias("remove"))
    terms = hit.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "remove"))).alias("terms"))
    terms = written(terms, "terms-of-texts")  # joined by itself, so that a text with very many copies can be split
    return rows.join(terms, "digest", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,remove:boolean>>")))


def _joined(items: Column) -> Column:
    """kind:start:stop, comma-joined, by start and kind; items: array<struct<start, k, stop>>."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(items), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _merged() -> Column:
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["stop"].alias("stop")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("k"), t["stop"].alias("stop")))
    return F.concat(base, terms)


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their kind (`<EMAIL>`), generalised terms by `<TERM>`, and removed terms cut out."""
    found = spans(docs).select(F.col("digest").alias("__digest"), "base", "terms").filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["__digest"])
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS[:4]])
    cuts = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.get(names, s["k"]).alias("to"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.when(t["remove"], "").otherwise("<TERM>").alias("to"))),
    )

    def rebuilt(cuts: Column) -> Column:
        """The text with its cuts made: run by run of the sorted cuts, each on the stretch of text up to its own end."""

        def run(at: Column, part: Column) -> Column:
            stop = F.greatest(at, F.array_max(F.transform(part, lambda s: s["stop"])))
            stretch = F.substr("text", at + 1, stop - at)

            def one(x: Column):
                def step(acc: Column, s: Column) -> Column:
                    kept = F.concat(acc["out"], F.substr(x, acc["at"] - at + 1, s["start"] - acc["at"]), s["to"])
                    new = F.struct(s["stop"].alias("at"), kept.alias("out"))
                    return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

                return F.aggregate(part, F.struct(at.alias("at"), F.lit("").alias("out")), step)

            return let(stretch, one)

        def each(acc: Column, i: Column) -> Column:
            return let(F.slice(cuts, i * STEP + 1, F.lit(STEP)), lambda part: let(run(acc["at"], part), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))))

        runs = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / STEP).cast("int"))
        folded = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), each)
        return let(folded, lambda f: F.concat(F.array_join(f["out"], ""), F.substr("text", f["at"] + 1, F.length("text"))))

    new = let(F.array_sort("__cuts"), rebuilt)
    rows = docs.withColumn("__digest", F.md5(F.coalesce(F.col("text"), F.lit("")))).join(found.select("__digest", cuts.alias("__cuts")), "__digest", "left")
    return rows.withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(new)).select(docs.columns)


def op5_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents."""
    rows = spans(table(spark, sf_dir, "documents"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["stop"].alias("stop")))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *map(count, range(4)), F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(_merged()).alias("spans"))
