"""Column-expression helpers for text.  Everything here returns a
``Column`` built from JVM-side functions, so it stays inside codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- ASCII folding (T1) -----------------------------------------------------
# One-to-one part: built by rule from Unicode decomposition of all Latin
# blocks (a letter whose canonical decomposition starts with an ASCII letter
# maps to that letter).  Combining marks are dropped, so composed and
# decomposed spellings fold alike; letters of other scripts stay as they are
# and count as word characters.
def _build_fold_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_SRC, _FOLD_DST = _build_fold_table()

# Letters and marks without a one-letter ASCII decomposition,
# spelled the way the usual transliteration tables spell them.
MULTI_CHAR_FOLDS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
    "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d",
    "Ð": "D", "ı": "i", "\u2018": "'", "\u2019": "'", "\u201c": '"',
    "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2026": "...",
    "\u00a0": " ", "\u200b": "",
}


def fold_ascii(c) -> Column:
    """Fold Latin letters with accents to ASCII (T1, without the trim)."""
    out = F.regexp_replace(F.translate(_col(c), _FOLD_SRC, _FOLD_DST), r"\p{Mn}+", "")
    for k, v in MULTI_CHAR_FOLDS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind
    (``F.trim`` removes spaces only)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def prep_encoding(c) -> Column:
    """Fold, strip; whitespace-only text becomes ''."""
    return strip_ws(fold_ascii(c))


def words(c) -> Column:
    """Python ``str.split()``: non-empty whitespace-separated tokens."""
    return F.filter(F.split(_col(c), r"\s+"), lambda w: w != F.lit(""))


def non_blank_lines(c) -> Column:
    """Lines of a stanza that hold at least one non-space character."""
    return F.filter(F.split(_col(c), "\n"),
                    lambda l: F.regexp_replace(l, r"\s+", "") != F.lit(""))


def lev_norm(a, b) -> Column:
    """M1: edit distance divided by the shorter length.  An empty shorter
    side gives NULL (the reference raises)."""
    a, b = _col(a), _col(b)
    return F.try_divide(F.levenshtein(a, b).cast("double"),
                        F.least(F.length(a), F.length(b)).cast("double"))


# --- title / corpus keys ----------------------------------------------------
def title_key(c) -> Column:
    """Text before '(', trimmed, lower-cased, zero-width spaces removed."""
    head = F.split_part(_col(c), F.lit("("), F.lit(1))
    return F.replace(F.lower(strip_ws(head)), F.lit("\u200b"), F.lit(""))


def bracket_repair(c) -> Column:
    """Undo line breaks inside brackets and remove all colons."""
    out = _col(c)
    for a, b in (("(\n", ""), ("\n)", ""), ("\n]", "]"), ("[\n", "["), (":", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def drop_last_line(c) -> Column:
    """C4: everything but the last '\\n'-separated line."""
    parts = F.split(_col(c), "\n", -1)
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "\n")


def ngram_key(c, keep_brackets: bool = False) -> Column:
    """Remove ``[...]`` (answer side), newline to space, drop
    ``\\r ' . ! , ?``, lower, strip."""
    out = _col(c)
    if not keep_brackets:
        out = F.regexp_replace(out, r"\[.*?\]", "")
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    out = F.translate(out, "\r'.!,?", "")
    return strip_ws(F.lower(out))


def annotation_trim(c) -> Column:
    """Cut an annotation at 'Expand +' and keep what follows the
    contributor count, in the five ordered cases of the reference."""
    d = _col(c)
    has_exp = d.contains("Expand +")
    head = F.split_part(d, F.lit("Expand +"), F.lit(1))
    return (
        F.when(has_exp & d.contains(" contributors"),
               F.split_part(head, F.lit(" contributors"), F.lit(2)))
        .when(has_exp & d.contains(" contributor"),
              F.split_part(head, F.lit(" contributor"), F.lit(2)))
        .when(has_exp, head)
        .when(d.contains(" contributors"), F.split_part(d, F.lit(" contributors"), F.lit(2)))
        .when(d.contains(" contributor"), F.split_part(d, F.lit(" contributor"), F.lit(2)))
        .otherwise(d)
    )
