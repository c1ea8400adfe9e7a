"""Text functions over columns: folds, tokens, error rates, replies."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that leave nothing to translate (a character class body).
PUNCTUATION = (
    r"\s\u2026\u2025\u30fb\u3002\u3001\uff0c,.\u2022!?\uff01\uff1f\u30fc\u2014\u2015\u2500~\uff5e\u301c\-\u2212"
    r"\u300c\u300d\u300e\u300f()\uff08\uff09:;\uff1a\uff1b\u3000'" + r'"' + r"\u201c\u201d\u2018\u2019*\uff0a"
)
# Closed-class English words.
FUNCTION_WORDS = (
    "the a an is are was were be been being am of and to in that it with for from this these those has have had will would shall should not but "
    "they their them he she his her him we our us you your i my me at on by or if as so than then there here what which who whom whose when where "
    "why how do does did can could may might must into about because while until unless although though after before over under between through "
    "during without within against"
).split()
# ASCII marks that may be split off a word.
ASCII_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
LANGUAGE_TAG = r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$"
SEPARATORS = {"zh": "", "ko": " "}
UNSAFE_SLUG = r"[^A-Za-z0-9._-]+"


def punctuation_only(text: Column) -> Column:
    """Not empty, and nothing but punctuation and blanks."""
    return F.coalesce((text != "") & text.rlike("^[" + PUNCTUATION + "]+$"), F.lit(False))


def is_null_word(text: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), F.lit("\"'"))) == "null", F.lit(False))


def is_language_tag(text: Column) -> Column:
    return F.coalesce(text.rlike(LANGUAGE_TAG), F.lit(False))


def canonical_ja(text: Column) -> Column:
    """Runs of three or more dots become one ellipsis, fullwidth letters and digits become ASCII."""
    wide = "".join(chr(c) for a, b in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(a, b))
    return F.translate(F.regexp_replace(text, "(?:\uff0e|\\.){3,}", "\u2026"), wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))


def canonical_zh(text: Column) -> Column:
    return F.translate(text, "?!,:;", "？！，：；")


def join_lines(lines: Column, lang: Column) -> Column:
    """Lines joined as the language spaces them; Chinese marks folded to their full width."""
    joined = F.array_join(lines, " ")
    return F.when(lang == "zh", canonical_zh(F.array_join(lines, ""))).otherwise(joined)


def cer(got: Column, want: Column) -> Column:
    """Character error rate, by code points."""
    empty = F.when(got == "", 0.0).otherwise(1.0)
    return F.when(want == "", empty).otherwise(F.levenshtein(got, want) / F.length(want))


def english_function_words(text: Column, allow: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return F.filter(words, lambda w: F.lower(w).isin(FUNCTION_WORDS) & ~F.array_contains(allow, F.lower(w)))


def _in(part: Column, whole: Column) -> Column:
    return F.contains(whole, part)


def chrf_words(text: Column) -> Column:
    """Words at white space, one ASCII mark split off the end or else the start."""
    marks = F.lit(ASCII_PUNCTUATION)

    def parts(w: Column) -> Column:
        last, first = F.substring(w, -1, 1), F.substring(w, 1, 1)
        n = F.length(w)
        return F.when((n > 1) & (_in(last, marks)), F.array(F.substring(w, F.lit(1), n - 1), last)).when((n > 1) & _in(first, marks), F.array(first, F.substring(w, F.lit(2), n))).otherwise(F.array(w))

    return F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), parts))


def chars(text: Column) -> Column:
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda c: c != "")


def ngrams(items: Column, n: int) -> Column:
    """Contiguous n-grams of an array of strings, joined by U+001F; the array is bound once, or each gram would make it anew."""

    def grams(items: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(items) - n + 1)
        return F.when(F.size(items) >= n, F.transform(at, lambda i: F.array_join(F.slice(items, i, n), "\x1f"))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(items), grams)[0]


def chrf_words_of(text: str) -> list[str]:
    """``chrf_words`` of one text in Python."""
    out = []
    for w in re.split(r"[ \t\n\x0b\f\r]+", text):
        if len(w) > 1 and w[-1] in ASCII_PUNCTUATION:
            out += (w[:-1], w[-1])
        elif len(w) > 1 and w[0] in ASCII_PUNCTUATION:
            out += (w[0], w[1:])
        elif w:
            out.append(w)
    return out


def ngram_counts(items: str | list[str], n: int) -> Counter:
    """``ngrams`` of one text in Python, counted; those of a string are its pieces of ``n`` characters."""
    at = range(len(items) - n + 1)
    return Counter([items[i : i + n] for i in at] if isinstance(items, str) else ["\x1f".join(items[i : i + n]) for i in at])


def model_slug(model: Column) -> Column:
    """A readable part and a digest: two models never share a name."""
    whole = F.coalesce(model, F.lit(""))
    safe = F.substring(F.btrim(F.regexp_replace(F.when(whole == "", "none").otherwise(whole), UNSAFE_SLUG, "-"), F.lit("-")), 1, 40)
    return F.concat(F.when(safe == "", "none").otherwise(safe), F.lit("-"), F.substring(F.sha2(whole, 256), 1, 8))


def translation_name(lang: Column, model: Column) -> Column:
    tag = F.regexp_replace(F.when(F.coalesce(lang, F.lit("")) == "", "none").otherwise(lang), UNSAFE_SLUG, "-")
    return F.concat(F.lit("tr_"), tag, F.lit("_"), model_slug(model), F.lit(".json"))


def job_key(job: Column) -> Column:
    safe = F.btrim(F.regexp_replace(job, UNSAFE_SLUG, "-"), F.lit("-."))
    part = F.substring(safe, 1, 40)
    return F.when((safe == job) & (job != ""), job).otherwise(F.concat(F.when(part == "", "job").otherwise(part), F.lit("-"), F.substring(F.sha2(job, 256), 1, 8)))


def rewrite_language(xml: Column, lang: Column) -> Column:
    """The info file with its language set: in the element, in an empty one, or in a new one before the end."""
    full = r"(?s)^(.*?<LanguageISO(?:\s[^>]*)?>)([^<]*)(</LanguageISO\s*>)"
    empty = r"(?s)^(.*?)<LanguageISO(?:\s[^>]*)?/>"
    close = r"(?s)^(.*?)(</ComicInfo\s*>)"
    value = F.concat(F.lit("<LanguageISO>"), lang, F.lit("</LanguageISO>"))
    return (
        F.when(xml.rlike(full), F.regexp_replace(xml, F.lit(full), F.concat(F.lit("$1"), lang, F.lit("$3"))))
        .when(xml.rlike(empty), F.regexp_replace(xml, F.lit(empty), F.concat(F.lit("$1"), value)))
        .when(xml.rlike(close), F.regexp_replace(xml, F.lit(close), F.concat(F.lit("$1  "), value, F.lit("\n$2"))))
        .otherwise(xml)
    )


REPLY = "struct<translations:array<struct<id:int,text:variant>>>"


def reply_map(raw: Column) -> Column:
    """Reply text as map id -> text: null and the word null are null, other types empty, the last of equal ids wins; null if there is no object."""
    end = F.length(raw) - F.locate("}", F.reverse(raw)) + 1
    body = F.when((F.locate("{", raw) > 0) & (F.locate("}", raw) > 0), F.substring(raw, F.locate("{", raw), end - F.locate("{", raw) + 1))
    parsed = F.from_json(body, REPLY)
    text = lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string"))

    def value(t: Column) -> Column:
        s = text(t["text"])
        missing = F.when(t["text"].isNull(), F.lit("")).when(F.is_variant_null(t["text"]), F.lit(None).cast("string"))
        return F.when(t["text"].isNull() | F.is_variant_null(t["text"]), missing).otherwise(F.when(s.isNull(), F.lit("")).when(is_null_word(s), F.lit(None).cast("string")).otherwise(s))

    items = F.transform(parsed["translations"], lambda t: F.struct(t["id"].alias("id"), value(t).alias("text")))
    last = F.filter(items, lambda t, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda u: u["id"] == t["id"]))
    return F.map_from_entries(last)


def stream_content(body: Column) -> Column:
    """Text of an event stream: the pieces of choice 0 up to [DONE], in order."""
    data = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))
    done = F.array_position(data, "[DONE]")
    live = F.when(done > 0, F.slice(data, F.lit(1), (done - 1).cast("int"))).otherwise(data)
    chunk = "struct<choices:array<struct<index:int,delta:struct<content:string>,message:struct<content:string>>>>"
    choices = F.flatten(F.transform(live, lambda d: F.coalesce(F.from_json(d, chunk)["choices"], F.from_json(F.lit("[]"), "array<struct<index:int,delta:struct<content:string>,message:struct<content:string>>>"))))
    first = F.filter(choices, lambda c: F.coalesce(c["index"], F.lit(0)) == 0)
    return F.array_join(F.transform(first, lambda c: F.coalesce(c["delta"]["content"], c["message"]["content"], F.lit(""))), "")


def is_transient(status: Column) -> Column:
    """Whether the same request has a chance when sent again."""
    return status.isin(0, 200, 408, 429) | (status >= 500)
