"""Normalisers, tokenisers, hashes and text metrics as Spark columns (all in the JVM)."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word character; Java's \w is ASCII alone.
WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
PLAIN_TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
NUMBER = r"^[0-9]+([hmds]?[a-zA-Z]*)?$"
SPACE = r"[\s\x{85}\p{Z}]+"


def _accents() -> tuple[str, str]:
    """Letters that decompose into one base character and marks, and those base characters."""
    a, b = [], []
    for i in range(128, sys.maxunicode + 1):
        d = unicodedata.normalize("NFKD", chr(i))
        if len(d) > 1 and len(base := "".join(c for c in d if not unicodedata.combining(c))) == 1 and i < 0x2000:
            a.append(chr(i))
            b.append(base)
    return "".join(a), "".join(b)


_FROM, _TO = _accents()
#: What ``fold`` turns to one blank; single blanks, nearly all of it, are passed over.
_BREAK = SPACE.removesuffix("]+") + r"_/\\\-"
_GAP = rf"{_BREAK}&&[^ ]]{_BREAK}]*+| {_BREAK}]++"


def unaccented(x: Column) -> Column:
    """Precomposed letters without accents; only text with any is looked through letter by letter."""
    return F.when(F.rlike(x, F.lit(r"[^\x00-\x7F]")), F.translate(x, _FROM, _TO)).otherwise(x)


def fold(x: Column) -> Column:
    """Lower case without accents, for text in precomposed Latin, Greek or Cyrillic letters; ``fold_any`` is for all of Unicode."""
    return F.trim(F.regexp_replace(unaccented(F.lower(x)), _GAP, " "))


def _fold_any(x: pd.Series) -> pd.Series:
    d = x.str.lower().str.normalize("NFKD")
    d = d.map(lambda t: "".join(c for c in t if not unicodedata.combining(c)), na_action="ignore")
    return d.str.replace(r"[_/\\-]+", " ", regex=True).str.replace(r"\s+", " ", regex=True).str.strip()


def fold_any(x: Column) -> Column:
    """Lower, NFKD, marks dropped, runs of _ / \\ - and white space to one blank, trimmed; null stays null. An Arrow UDF: Spark has no NFKD."""
    return F.pandas_udf(_fold_any, StringType())(x)


def collapse(x: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def preview(x: Column, most: int = 220) -> Column:
    c = collapse(x)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def tokens(x: Column) -> Column:
    """Words of the lower-cased text, inner apostrophes and hyphens included."""
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), 0)


def plain_words(x: Column) -> Column:
    """Words of the folded text; those fit for the sparse index pass ``is_term``. The blanks that ``fold`` makes of other separators part no more words, except for underscores."""
    return F.regexp_extract_all(unaccented(F.lower(x)), F.lit(PLAIN_TOKEN.replace("_", "")), 0)


def is_term(w: Column, stop: list[str]) -> Column:
    """Two characters or more, no stop words, no numbers with units."""
    return (F.length(w) >= 2) & ~w.isin(*stop) & ~F.rlike(w, F.lit(NUMBER))


def sparse_tokens(x: Column, stop: list[str]) -> Column:
    """Words of the folded text for the sparse index."""
    return F.filter(plain_words(x), lambda w: is_term(w, stop))


def has_terms(x: Column, stop: list[str]) -> Column:
    """Whether ``sparse_tokens`` has any: at once where a word of ASCII letters, longer than any stop word, stands between blanks."""
    plain = rf"(?<![^ ])[a-zA-Z]{{{max(map(len, [*stop, 'x'])) + 1},}}(?![^ ])"
    return F.when(F.rlike(x, F.lit(plain)), True).otherwise(F.size(sparse_tokens(x, stop)) > 0)


def chunk_key(x: Column) -> Column:
    return F.sha1(F.lower(collapse(x)))


def hash64(word: Column) -> Column:
    """The low half of a word's md5."""
    return F.conv(F.substring(F.md5(word), 17, 16), 16, -10).cast("long")


def simhash64(h: Column) -> Column:
    """Aggregate: 64-bit simhash of a group of ``hash64``; nulls don't count, and no hashes give 0.

    Each of 32 sums counts two bits at once, in its two halves, so that a hash costs 32 additions."""
    votes = F.count(h)

    def majority(ones: Column, b: int) -> Column:
        return F.when(2 * ones > votes, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")

    out = None
    for b in range(32):
        s = F.sum(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(0x1_0000_0001)))
        for bit in (majority(s.bitwiseAND(F.lit(0xFFFF_FFFF)), b), majority(F.shiftrightunsigned(s, 32), b + 32)):
            out = bit if out is None else out.bitwiseOR(bit)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def years(x: Column) -> Column:
    """Years 1900 to 2099 standing alone, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int"))))


def hits(x: Column, lexicon: list[str]) -> Column:
    """Entries of a lexicon (a short list) that the text contains, in its order. ``x`` stands once for each entry: give it as a column that is made before."""
    return F.array_compact(F.array(*[F.when(F.contains(x, F.lit(k)), F.lit(k)) for k in lexicon]))


def aliases(x: Column, names: dict[str, list[str]]) -> Column:
    """Canonical names with an alias standing as a word of the text, in the order of ``names``. ``x`` is to be a column, as for ``hits``."""
    tests = [F.when(x.rlike("(?<![\\p{L}\\p{N}_])(?:" + "|".join(a) + ")(?![\\p{L}\\p{N}_])"), F.lit(n)) for n, a in names.items()]
    return F.array_compact(F.array(*tests))


def first_rule(x: Column, rules: dict[str, list[str]], other: str = "general") -> Column:
    """The first rule (in order) with any entry contained in the text. ``x`` is to be a column, as for ``hits``."""
    out = None
    for name, entries in rules.items():
        test = reduce(Column.__or__, [F.contains(x, F.lit(k)) for k in entries])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def rounded(x: Column, digits: int) -> Column:
    """Halves away from zero of the scaled double, as DuckDB rounds; F.round rounds the shortest decimal, so that 0.73135 gives 0.7314 instead of 0.7313."""
    y = F.abs(x) * 10.0**digits
    low = F.floor(y)
    return F.signum(x) * ((low + F.when(y - low >= 0.5, 1).otherwise(0)) / 10.0**digits)
