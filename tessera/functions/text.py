"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed; null becomes empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


def search_tokens(text: Column) -> Column:
    """Sorted distinct tokens: the whole normalised value (if longer than 1), its Latin words, and bigrams of its characters."""
    value = normalise(text)
    bigrams = F.regexp_extract_all(F.regexp_replace(value, r"\s", ""), F.lit("(?s)(?=(..))."), F.lit(1))  # overlapping
    whole = F.when(F.length(value) > 1, F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(whole, F.regexp_extract_all(value, F.lit("[a-zA-Z0-9]+"), F.lit(0)), bigrams)))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens, parted by white space and the CJK commas."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s、，]+"), lambda t: t != ""))


def contains(haystack: Column, needle: Column) -> Column:
    """Case-insensitive containment; an empty or null needle is never contained."""
    found = F.contains(F.lower(haystack), F.lower(F.trim(needle)))
    return F.coalesce((F.trim(needle) != "") & found, F.lit(False))


def mapped(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A controlled vocabulary: the table's form of the trimmed value, else the default (the value itself)."""
    out = F.trim(value) if default is None else default
    for k, v in table.items():
        out = F.when(F.trim(value) == k, F.lit(v)).otherwise(out)
    return out


def first_category(text: Column, categories: list[tuple[str, list[str]]], other: str) -> Column:
    """The first category of which a term is contained in the text."""
    chain = None
    for name, terms in categories:
        hit = F.coalesce(text, F.lit("")).rlike("|".join(f"\\Q{t}\\E" for t in terms))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.lit(other) if chain is None else chain.otherwise(other)


# Endings of Chinese administrative names.
ADMIN_SUFFIXES = ("特别行政区", "自治区", "自治州", "自治县", "省", "市", "区", "县", "镇", "乡")


def strip_admin_suffix(name: Column) -> Column:
    """The name without its administrative ending, if at least two characters are left."""
    short = F.regexp_replace(F.trim(name), f"({'|'.join(ADMIN_SUFFIXES)})$", "")
    return F.when(F.length(short) >= 2, short).otherwise(F.trim(name))


#: Prices, phone numbers and years as they stand in read text.
PRICE = r"(?:¥|￥)\s*(\d+(?:\.\d+)?)|(\d+(?:\.\d+)?)\s*(?:元|块)"
PHONE = r"(?<!\d)(\d{7,12})(?!\d)"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def hard_values(text: Column) -> Column:
    """array<struct<kind, value>>: prices, then years, then phone numbers, each in text order."""
    named = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    prices = F.transform(F.regexp_extract_all(text, F.lit(PRICE), F.lit(0)), lambda m: F.regexp_extract(m, r"\d+(?:\.\d+)?", 0))
    return F.concat(named("price", prices), named("year", F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))), named("phone", F.regexp_extract_all(text, F.lit(PHONE), F.lit(1))))


def prompt_tokens(text: Column) -> Column:
    """Estimated prompt tokens: 0.7 a CJK character, 0.25 any other, and 400."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return F.floor(cjk * 0.7 + (F.length(text) - cjk) * 0.25 + 400).cast("long")


def leaks_internal_id(text: Column) -> Column:
    """Whether an answer shows an internal id (prefix and 12 hex digits) or an unfilled placeholder."""
    return text.rlike(r"\b(?:asset|obs|observation|event|entity|claim|fact|card)_[0-9a-f]{8,}\b") | text.rlike(r"\{\{[^}]*\}\}|\$\{[^}]*\}")


def short_title(text: Column, most: int = 24) -> Column:
    """The first line's first characters, with an ellipsis where more is left."""
    line = F.trim(F.split(F.trim(text), r"\n")[0])
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def sentences(text: Column) -> Column:
    """array<struct<start, stop, text>>: claims, i.e. stretches up to a sentence mark, trimmed of nothing, in order.

    Offsets are sums of lengths, made in runs so that an append never copies much.
    """
    step = 128
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"([^。！？!?\n]*[。！？!?\n]|[^。！？!?\n]+$)"), F.lit(1)), lambda p: p != "")
    none = F.array().cast("array<struct<start:int,stop:int,text:string>>")

    def one(acc: Column, p: Column) -> Column:
        stop = acc["at"] + F.length(p)
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), stop.alias("stop"), p.alias("text")))).alias("out"))

    def runs(xs: Column) -> Column:
        def each(acc: Column, i: Column) -> Column:
            run = F.aggregate(F.slice(xs, i * step + 1, F.lit(step)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return F.get(F.transform(F.array(run), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), F.lit(0))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int,text:string>>>").alias("out"))
        whole = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int")), start, each)
        return F.when(F.size(xs) > 0, F.filter(F.flatten(whole["out"]), lambda s: F.trim(s["text"]) != "")).otherwise(none)

    return F.get(F.transform(F.array(parts), runs), F.lit(0))


def claim_kind(text: Column, kinds: list[tuple[str, str]], other: str = "statement") -> Column:
    """The first kind whose pattern a claim's text matches."""
    out = F.lit(other)
    for kind, pattern in reversed(kinds):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), kind).otherwise(out)
    return out


def place_label(inner: Column, outer: Column, outer_first: Column) -> Column:
    """A place's label: outer and inner name run together where that is the custom, else inner, comma, outer; empty if unknown."""
    i, o = F.coalesce(inner, F.lit("")), F.coalesce(outer, F.lit(""))
    plain = F.concat_ws(", ", F.when(i != "", i), F.when(o != "", o))
    return F.when(F.coalesce(outer_first, F.lit(False)), F.concat(o, i)).otherwise(plain)
