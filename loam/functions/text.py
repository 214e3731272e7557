"""Text functions as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default stop words; any list may be given instead.
STOP_WORDS = ("и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "the", "of", "and", "to", "in")
MARK = "\u0001"


def chars(text: Column, outside: str) -> Column:
    """How many characters are left when those matching `outside`, a class, go."""
    return F.length(F.regexp_replace(text, f"{outside}+", ""))


def token_estimate(text: Column) -> Column:
    """Weighted count of Cyrillic, Latin, other characters and blanks; at least 1, and 0 for null or empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    counted = F.struct(n.alias("n"), chars(t, "[^а-яА-Я]").alias("cyr"), chars(t, "[^a-zA-Z]").alias("lat"), (n - F.length(F.replace(t, F.lit(" "), F.lit("")))).alias("blank"))

    def weigh(p: Column) -> Column:
        other = p["n"] - p["cyr"] - p["lat"] - p["blank"]
        total = (p["cyr"] * F.lit(0.5) + p["lat"] * F.lit(0.4) + other * F.lit(0.3) + p["blank"] * F.lit(0.1)) * F.lit(1.2)
        return F.when(p["n"] == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(total).cast("int"))).cast("long")

    return F.get(F.transform(F.array(counted), weigh), F.lit(0))  # within other functions Spark counts anew at each mention


def token_count(text: Column) -> Column:
    """The estimate, but 0 for blank text."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0).cast("long")).otherwise(token_estimate(text))


def token_limit(text: Column, most: int = 2048) -> Column:
    return F.struct((token_count(text) <= most).alias("within"), token_count(text).alias("n_tokens"))


def stripped(text: Column) -> Column:
    """Without the characters of \\s at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ? before white space; empty ones are dropped."""
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?])\s++|{MARK}")
    return F.filter(pieces, lambda s: s.rlike(r"\S"))


def normalised(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased words of letters and digits alone, without stop words, joined by blanks."""
    return F.array_join(terms(text, stop_words), " ")


def terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    none_of = rf"(?!(?:{'|'.join(map(re.escape, stop_words))})(?!\S))" if stop_words else ""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!\S){none_of}[\p{{L}}\p{{N}}]++(?!\S)"), F.lit(0))


def name_terms(name: Column) -> Column:
    """Words of a file or sheet name: cut at everything that is no letter or digit, so that report.pdf gives two."""
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def eligible_sentence(s: Column, n_entities: Column | None = None) -> Column:
    """10 to 500 characters, a letter, at most half upper case, and more than one entity where their number is given."""
    ok = F.length(s).between(10, 500) & s.rlike(r"\p{L}") & (chars(s, r"[^\p{Lu}]") * 2 <= F.length(s))
    return ok if n_entities is None else ok & (n_entities > 1)


def packed(pieces: Column, size: Column | int, overlap: int = 0, glue: str = " ") -> Column:
    """Greedy packing in order: a piece that would pass the size closes the chunk, whose last `overlap` characters
    open the next. Pieces are never cut. Chunks are trimmed and empty ones dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        full = F.length(acc["open"]) + F.length(piece) > size
        tail = F.right(acc["open"], F.lit(overlap)) if overlap else F.lit("")
        return F.struct(
            F.when(full, F.array_append(acc["done"], stripped(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, tail).otherwise(acc["open"]), piece, F.lit(glue)).alias("open"),
        )

    return F.aggregate(pieces, start, add, lambda acc: F.filter(F.array_append(acc["done"], stripped(acc["open"])), lambda c: c != ""))


def chunks(text: Column, size: int = 500, overlap: int = 100) -> Column:
    return packed(sentences(text), size, overlap)


def bounded_pieces(text: Column, most: int) -> Column:
    """Sentences of at most `most` characters; longer ones as words, longer words cut. Nothing is lost and order stays."""
    cut = lambda w: F.when(F.length(w) <= most, F.array(w)).otherwise(slices(w))
    slices = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(w) / most).cast("int") - 1, F.lit(0))), lambda i: F.substring(w, i * most + 1, F.lit(most)))
    of = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.flatten(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), cut)))
    return F.flatten(F.transform(sentences(text), of))


def split_by_tokens(text: Column, max_tokens: int = 1800) -> Column:
    """Chunks of about max_tokens by two characters a token; blank text gives none."""
    most = 2 * max_tokens
    return packed(bounded_pieces(text, most), most + 1)


def halves(text: Column) -> Column:
    """A long text cut in the middle, as a last resort."""
    middle = F.floor(F.length(text) / 2).cast("int")
    return F.when(F.length(text) > 3600, F.array(F.substring(text, F.lit(1), middle), F.substring(text, middle + 1, F.length(text)))).otherwise(F.array(text))


def entities(text: Column) -> Column:
    """Default entity finder: words of one capital and at least two small letters that do not open a sentence; distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{Ll},;] (\p{Lu}\p{Ll}{2,})"), 1))


def cleaned_reply(text: Column) -> Column:
    """A model's reply without zero-width signs, code fences and backticks."""
    t = stripped(F.regexp_replace(F.coalesce(text, F.lit("")), "[\u200b-\u200d\ufeff]", ""))
    rows = F.split(t, "\n")
    fenced = F.when(F.size(rows) > 2, F.array_join(F.slice(rows, 2, F.size(rows) - 2), "\n")).otherwise(F.regexp_replace(t, r"^```|```$", ""))
    t = F.when(t.startswith("```") & t.endswith("```"), fenced).otherwise(t)
    return stripped(F.regexp_replace(stripped(t), r"^`|`$", ""))


def reranked(reply: Column, n: Column) -> Column:
    """0-based places named in a reply such as "3, 1, 5": the valid ones, first mention wins; none valid: the old order; empty: none."""
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    items = F.transform(F.split(reply, ","), lambda x: F.trim(x))
    named = F.transform(F.filter(items, lambda x: x.rlike("^[0-9]{1,9}$")), lambda x: x.cast("int") - 1)
    valid = F.array_distinct(F.filter(named, lambda i: (i >= 0) & (i < n)))
    return F.when(F.trim(F.coalesce(reply, F.lit(""))) == "", F.array().cast("array<int>")).when(F.size(valid) == 0, every).otherwise(valid)


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")


#: Phrases of an answer that found nothing.
NOT_FOUND = (
    "я не нашел информации в документах",
    "я не нашел релевантной информации",
    "нет информации в документах",
    "информация отсутствует",
    "не удалось найти",
)


def answered(answer: Column, failed: Column | None = None) -> Column:
    """Whether an answer holds none of the phrases and its generator did not fail."""
    ok = ~F.lower(F.coalesce(answer, F.lit(""))).rlike("|".join(NOT_FOUND))
    return ok if failed is None else ok & ~failed


def widened(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def is_spreadsheet(content_type: Column, name: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).rlike("spreadsheet|ms-excel") | F.lower(F.coalesce(name, F.lit(""))).rlike(r"\.xlsx?$")
