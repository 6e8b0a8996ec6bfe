"""Column expressions over text: headlines, bigrams, overlap, matching, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Digests whose headline says nothing of their content.
GENERIC_HEADLINES = ("国内联播快讯", "国际联播快讯", "联播快讯", "新闻联播")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def like(c: Column, pattern: str) -> Column:
    """Substring match that folds ASCII case only; ``%`` and ``_`` in the pattern are wildcards and nothing escapes them."""
    return ascii_lower(c).like(pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def contains(c: Column, keyword: str) -> Column:
    return like(c, f"%{keyword}%")


def headline(title: Column) -> Column:
    """A title without a bracketed prefix and without anything but letters and digits, in lower case."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(title, "^【[^】]{1,32}】", "")), r"[^\p{L}\p{N}]+", "")
    return F.lower(bare)


def is_generic(head: Column) -> Column:
    return head.isin(*GENERIC_HEADLINES)


def grams(head: Column) -> Column:
    """Distinct character bigrams of a headline; none for a generic or very short one."""
    chars, n = F.split(head, ""), F.greatest(F.length(head) - 1, F.lit(0))
    two = F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))  # linear in the length
    return F.when((F.length(head) < 4) | is_generic(head), F.array().cast("array<string>")).otherwise(F.array_distinct(two))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all of two arrays; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)).cast("double")).otherwise(F.lit(0.0))


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def news_id(date: Column, order: Column) -> Column:
    return hash16(F.concat_ws(":", date.cast("string"), order.cast("string")))


def event_id(members: Column) -> Column:
    """Id of an event from the array of its items' ids."""
    return hash16(F.array_join(F.array_sort(F.array_distinct(members)), ","))


def preview_id(members: Column) -> Column:
    return F.concat(F.lit("preview-"), hash16(F.array_join(F.array_sort(F.array_distinct(members)), "|")))


# Topics of the taxonomy with the readings of their characters.
TOPIC_READINGS = {
    "政治": "zheng zhi", "经济": "jing ji", "外交": "wai jiao", "军事": "jun shi", "科技": "ke ji", "社会": "she hui",
    "文化": "wen hua", "生态": "sheng tai", "国际关系": "guo ji guan xi", "中美关系": "zhong mei guan xi", "一带一路": "yi dai yi lu", "乡村振兴": "xiang cun zhen xing",
    "高质量发展": "gao zhi liang fa zhan", "改革开放": "gai ge kai fang", "党的建设": "dang de jian she", "法治建设": "fa zhi jian she", "民生保障": "min sheng bao zhang", "国防安全": "guo fang an quan",
}


def readings_of(words: dict[str, str]) -> dict[str, str]:
    """Words with their readings, and each of their characters with the first reading that a word gives it."""
    out = dict(words)
    for word, reading in words.items():
        for c, r in zip(word, reading.split(), strict=True):
            out.setdefault(c, r)
    return out


def slug(name: Column, readings: dict[str, str] | None = None) -> Column:
    """Topic id: the readings of a name's words, longest match first, joined by hyphens; a run of characters that have none stays as it is.

    ``readings`` maps words or characters to readings with spaces between syllables, by
    default those of the fixed topics.
    """
    known = readings_of(TOPIC_READINGS) if readings is None else readings
    if not known:
        return name
    word = "|".join(re.escape(w) for w in sorted(known, key=lambda w: (-len(w), w)))
    table = F.create_map(*[F.lit(x) for w, r in known.items() for x in (w, r.replace(" ", "-"))])
    parts = F.regexp_extract_all(name, F.lit(rf"({word}|(?:(?!{word})[\s\S])+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.element_at(table, w), w)), "-")


def round_even(x: Column, digits: int) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, exact ties to the even digit, as in Python.

    The product with the power of ten is split into its double and what that leaves out,
    both exact, so that a tie is a tie of the value and not of its rounded product.
    """
    s = F.lit(float(10**digits))
    x = x.cast("double")
    p = x * s
    c = x * F.lit(134217729.0)  # 2 ** 27 + 1: halves of 26 bits
    high = c - (c - x)
    rest = (high * s - p) + (x - high) * s
    k = F.floor(F.when(F.abs(p) < 2.0**52, p)).cast("double")
    over = p - k
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (F.abs(k % 2) == 1))))
    return F.when(F.abs(p) < 2.0**52, (k + F.when(up, 1.0).otherwise(0.0)) / s).otherwise(x)


def round_even_sql(x: str, digits: int) -> str:
    """:func:`round_even` for DuckDB, of values whose product is below 2 ** 52."""
    s = f"{10**digits}.0::double"
    rest = f"((v * 134217729.0::double - (v * 134217729.0::double - v)) * {s} - v * {s}) + (v - (v * 134217729.0::double - (v * 134217729.0::double - v))) * {s}"
    k = f"floor(v * {s})"
    over = f"(v * {s} - {k})"
    return f"(list_transform([({x})::double], lambda v: ({k} + case when {over} > 0.5 or ({over} = 0.5 and (({rest}) > 0 or (({rest}) = 0 and abs({k} % 2) = 1))) then 1 else 0 end) / {s}))[1]"


def safe_url(url: Column) -> Column:
    """The URL if it is http or https, else null."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), url)
