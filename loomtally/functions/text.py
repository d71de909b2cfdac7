"""Column functions over text: identity, white space, lexical tokens, shingles.

Lengths are in code points, byte counts in UTF-8. White space is that of Python's
str.split, which Java's classes don't cover, so it is spelled out; lexical tokens
are runs of letters, digits and `_`, or one other character that is not white space.
"""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split knows it (Java and RE2 spelling).
SPACE_JAVA = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RE2 = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LEXEME = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + SPACE_JAVA + "]"


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE_JAVA}]+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | (normalized(text) == "")


def stripped_length(text: Column) -> Column:
    """Code points without white space at the ends."""
    return F.length(F.regexp_replace(text, f"^[{SPACE_JAVA}]+|[{SPACE_JAVA}]+$", ""))


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({LEXEME})"), 1)


def shingle_hashes(tokens: Column, width: int = 5) -> Column:
    """Distinct 64-bit hashes of `width` successive tokens; of all tokens if they are fewer."""

    def of(t: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(t, "\x00")))
        many = F.transform(F.sequence(F.lit(1), F.size(t) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i, width), "\x00")))
        return F.array_distinct(F.when(F.size(t) < width, whole).otherwise(many))

    # as a lambda's variable the tokens are computed once and not again for each shingle
    return F.transform(F.array(tokens), of)[0]


@cache
def case_folding() -> tuple[dict[str, str], dict[str, str]]:
    """(code points that fold to one other, those that fold to several), by Python's str.casefold."""
    every = (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    folds = {c: f for c in every if (f := c.casefold()) != c}
    return {c: f for c, f in folds.items() if len(f) == 1}, {c: f for c, f in folds.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding, as str.casefold. Texts of ASCII characters alone are lowered."""
    single, several = case_folding()
    folded = F.translate(text, "".join(single), "".join(single.values()))
    steps = F.array(*[F.array(F.lit(c), F.lit(f)) for c, f in several.items()])
    spread = F.aggregate(steps, folded, lambda s, step: F.replace(s, step[0], step[1]))
    whole = F.when(folded.rlike("[" + "".join(several) + "]"), spread).otherwise(folded)
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(whole)


def repository_family(repo: Column) -> Column:
    """Case-folded name of `owner/name`; null where there is not just one slash between two names."""
    parts = F.split(repo, "/")
    good = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    return F.when(good, casefold(parts[1]))


def portable_key(seed: int, *parts: Column) -> Column:
    """A pseudorandom 60-bit order key that other SQL engines can compute: the first 15
    hexadecimal digits of md5('seed|part|...')."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
