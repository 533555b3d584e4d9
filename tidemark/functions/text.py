"""Text expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Initials of Hangul syllables in code order.
INITIALS = ("ㄱ", "ㄲ", "ㄴ", "ㄷ", "ㄸ", "ㄹ", "ㅁ", "ㅂ", "ㅃ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅉ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ")


def collapsed(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compact(text: Column) -> Column:
    """Without ASCII white space, as of `\\s`. Plain replacements take a small part of the time of a regular expression."""
    for blank in " \t\n\v\f\r":
        text = F.replace(text, F.lit(blank))
    return text


def search_key(text: Column) -> Column:
    """Lower case without brackets, spaces and joining signs. Full-width forms stay as they are: Spark has no NFKC."""
    return F.lower(F.regexp_replace(text, r"[\s()\[\]{}·.,\-]+", ""))


def group_key(text: Column) -> Column:
    """Without brackets and white space; empty is `unknown`."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s()\[\]{}]+", "")
    return F.when(out == "", "unknown").otherwise(out)


def strip_suffix(text: Column, suffixes: tuple[str, ...]) -> Column:
    return F.regexp_replace(text, f"(?:{'|'.join(suffixes)})$", "")


def search_rank(query: Column, aliases: Column) -> Column:
    """0 if an alias equals the query, 1 if one begins with it, 2 if one contains it, else null. All compared as search keys."""
    q, keys = search_key(query), F.transform(aliases, search_key)
    return F.when(q == "", None).when(F.array_contains(keys, q), 0).when(F.exists(keys, lambda k: k.startswith(q)), 1).when(F.exists(keys, lambda k: k.contains(q)), 2)


def initial(text: Column) -> Column:
    """The first letter: the initial consonant of a Hangul syllable, else the upper-case character."""
    code = F.ascii(text)
    names = F.array(*(F.lit(x) for x in INITIALS))
    return F.when((code >= 0xAC00) & (code <= 0xD7A3), F.element_at(names, (F.floor((code - 0xAC00) / 588) + 1).cast("int"))).otherwise(F.upper(F.substring(text, 1, 1)))


def canonical_url(url: Column, *, sort_query: bool = False) -> Column:
    """Scheme and host in lower case, no fragment. Plain: no slash at the end. With sort_query: parameters sorted, an empty path is `/`."""
    part = lambda i: F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    path, query = part(3), F.regexp_replace(part(4), r"^\?", "")
    head = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)))
    if sort_query:
        path = F.when(path == "", "/").otherwise(path)
        query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    out = F.concat(head, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(1) != "", out if sort_query else F.regexp_replace(out, "/+$", "")).otherwise(F.trim(url))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))


def listed(text: Column, separators: str = ",\n") -> Column:
    """Trimmed non-empty items of a delimited text."""
    return F.filter(F.transform(F.split(text, f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != "")


def years(text: Column, low: int, high: int) -> Column:
    """Distinct four-digit years within a range, ascending."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2})"), 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(low, high))))


# --- fixed values: forms of dates ---
FULL_DATE = r"(?:20[0-9]{2}|['′][0-9]{2})\s*[.\-년]\s*(?:1[0-2]|0?[1-9])\s*[.\-월]\s*(?:[12][0-9]|3[01]|0?[1-9])(?![0-9])\s*[.\-일]?(?:\s*\([^)]{1,8}\))?(?:\s*[0-9]{1,2}:[0-9]{2})?"
SHORT_DATE = r"(?<![0-9])(?:1[0-2]|0?[1-9])\s*[.월]\s*(?:[12][0-9]|3[01]|0?[1-9])(?![0-9])\s*[.일]?(?:\s*\([^)]{1,8}\))?(?:\s*[0-9]{1,2}:[0-9]{2})?"
# --- end of fixed values ---


def dates(text: Column, most: int = 80) -> Column:
    """Distinct dates by position, at most `most`: with a year, or month and day outside of such a date. White space is single, signs at the ends are gone.

    The full form comes first in the alternation and takes its whole span, so that what lies inside it isn't found again.
    """
    found = F.regexp_extract_all(text, F.lit(f"({FULL_DATE}|{SHORT_DATE})"), F.lit(1))
    tidy = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ ,;]+|[ ,;]+$", ""))
    return F.slice(F.array_distinct(F.filter(tidy, lambda x: x != "")), 1, most)


def quotas(text: Column, most: int = 80) -> Column:
    """Distinct head counts of 1 to 500 that stand before the counter word."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]{1,4})\s*명"), 1), lambda x: x.cast("int"))
    return F.slice(F.array_distinct(F.filter(found, lambda n: n.between(1, 500))), 1, most)


def quota_numbers(text: Column, given: Column, terms: str, most: int = 80) -> Column:
    """Distinct whole numbers of 1 to 500, at most `most`: the given ones; if there are none and the text has one of the terms, those that stand alone in it (no part of a decimal, no percentage)."""
    fits = lambda numbers: F.filter(numbers, lambda n: n.between(1, 500))
    own = fits(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.trim(x).try_cast("int")))
    alone = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9.])([1-9][0-9]{0,2}|0)(?![0-9.%])"), F.lit(1)), lambda x: x.cast("int"))
    chosen = F.when(F.size(own) > 0, own).when(text.rlike(terms), fits(alone)).otherwise(F.array().cast("array<int>"))
    return F.slice(F.array_distinct(chosen), 1, most)


def plain_text(html: Column) -> Column:
    """Visible text of markup: scripts, styles, comments and tags out, common entities decoded, control characters out."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return collapsed(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def first_filled(*columns: Column) -> Column:
    """The first column whose text isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def excerpt(text: Column, terms: list[str], before: int = 180, after: int = 520, otherwise: int = 700) -> Column:
    """Text around the first term, in the order of terms, that occurs; else its beginning."""
    found = [F.when(F.instr(text, t) > 0, F.substring(text, F.greatest(F.instr(text, t) - before, F.lit(1)), F.least(F.instr(text, t) - 1, F.lit(before)) + after)) for t in terms]
    return F.coalesce(*found, F.substring(text, 1, otherwise))


def member_or(value: Column, known: tuple[str, ...], otherwise: str) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*known), F.lower(F.trim(value))).otherwise(F.lit(otherwise))


def label_path(levels: list[Column]) -> Column:
    """Header levels to `a > b`: blanks and repeats of the level before fall out."""
    parts = F.filter(F.array(*levels), lambda x: x.isNotNull() & (F.trim(x) != ""))
    kept = F.filter(parts, lambda x, i: (i == 0) | (x != F.element_at(parts, F.greatest(i, F.lit(1)))))
    return F.array_join(kept, " > ")
