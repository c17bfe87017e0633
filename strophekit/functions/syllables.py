"""The rule-based syllable count of a word as one column expression.

The rule list runs in a fixed order (SURVEY quirk 14); the result may be
zero or negative, and is kept as is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's word lists.
EXCEPTION_ADD = ("serious", "crucial")
EXCEPTION_DEL = ("fortunately", "unfortunately")
CO_ONE = ("cool", "coach", "coat", "coal", "count", "coin", "coarse", "coup",
          "coif", "cook", "coign", "coiffe", "coof", "court")
CO_TWO = ("coapt", "coed", "coinci")
PRE_ONE = ("preach",)
LE_EXCEPT = ("whole", "mobile", "pole", "male", "female", "hale", "pale",
             "tale", "sale", "aisle", "whale", "while")
NEGATIVE = ("doesn't", "isn't", "shouldn't", "couldn't", "wouldn't")
VOWELS = "eaoui"
# ---------------------------------------------------------------------------

_V = f"[{VOWELS}]"
_NV = f"[^{VOWELS}]"


def _ends(w: Column, s: str) -> Column:
    return w.endswith(s)


def _char(w: Column, i: int) -> Column:
    """0-based character ``i`` (negative counts from the end)."""
    return F.substring(w, i + 1 if i >= 0 else i, 1)


def _is_vowel(ch: Column) -> Column:
    return ch.isin(*VOWELS)


def syllable_rule(word: Column) -> Column:
    """Rule-based syllable count (no lexicon, no number spelling)."""
    w = F.lower(word)
    pairs = F.regexp_count(w, F.lit(_V + _V))
    triples = F.regexp_count(w, F.lit(_V + _V + _V))
    vc_pairs = F.regexp_count(w, F.lit(_V + _NV))

    # discarded syllables
    disc_esed = F.when(
        (_ends(w, "es") | _ends(w, "ed"))
        & ((pairs > 1) | (vc_pairs > 1))
        & ~(_ends(w, "ted") | _ends(w, "tes") | _ends(w, "ses")
            | _ends(w, "ied") | _ends(w, "ies")), 1).otherwise(0)
    disc_e = F.when(_ends(w, "e") & ~(_ends(w, "le") & ~w.isin(*LE_EXCEPT)), 1).otherwise(0)
    disc = disc_esed + disc_e + pairs + triples + F.when(w.isin(*EXCEPTION_DEL), 1).otherwise(0)

    vowels = F.regexp_count(w, F.lit(_V))

    # added syllables
    add = F.when(w.startswith("mc"), 1).otherwise(0)
    add = add + F.when(_ends(w, "y") & ~_is_vowel(_char(w, -2)), 1).otherwise(0)
    # inner 'y' between two non-vowels (lookarounds keep neighbours shared)
    add = add + F.regexp_count(w, F.lit(f"(?<={_NV})y(?={_NV})"))
    add = add + F.when(w.startswith("tri") & _is_vowel(_char(w, 3)), 1).otherwise(0)
    add = add + F.when(w.startswith("bi") & _is_vowel(_char(w, 2)), 1).otherwise(0)
    add = add + F.when(_ends(w, "ian") & ~(_ends(w, "cian") | _ends(w, "tian")), 1).otherwise(0)
    pre4, pre5, pre6 = F.substring(w, 1, 4), F.substring(w, 1, 5), F.substring(w, 1, 6)
    co = w.startswith("co") & _is_vowel(_char(w, 2))
    in_two = pre4.isin(*CO_TWO) | pre5.isin(*CO_TWO) | pre6.isin(*CO_TWO)
    in_one = pre4.isin(*CO_ONE) | pre5.isin(*CO_ONE) | pre6.isin(*CO_ONE)
    add = add + F.when(co & (in_two | ~in_one), 1).otherwise(0)
    add = add + F.when(w.startswith("pre") & _is_vowel(_char(w, 3)) & ~pre6.isin(*PRE_ONE),
                       1).otherwise(0)
    add = add + F.when(_ends(w, "n't") & w.isin(*NEGATIVE), 1).otherwise(0)
    add = add + F.when(w.isin(*EXCEPTION_ADD), 1).otherwise(0)

    return F.when(F.length(w) <= 3, F.lit(1)).otherwise(vowels - disc + add).cast("int")


# --- E3: numbers spelled out before the rule --------------------------------
# English number words.
SMALL_NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
                 "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
                 "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
# The stems from which names of powers of a thousand are built.
FIRST_STEMS = ("m", "b", "tr", "quadr", "quint", "sext", "sept", "oct", "non")
UNIT_STEMS = ("", "un", "duo", "tre", "quattuor", "quin", "sex", "sept", "octo", "novem")
TEN_STEMS = ("dec", "vigint", "trigint", "quadragint", "quinquagint", "sexagint", "septuagint", "octogint", "nonagint")
POWERS = ("", "thousand", *[stem + "illion" for stem in (
    *FIRST_STEMS, *[unit + ten for ten in TEN_STEMS for unit in UNIT_STEMS], "cent")])


def _spell_below_100(n: Column) -> Column:
    small = F.array(*[F.lit(w) for w in SMALL_NUMBERS])
    tens = F.array(*[F.lit(w) for w in TENS])
    unit = F.element_at(small, (n % 10 + 1).cast("int"))
    return F.when(n < 20, F.element_at(small, (n + 1).cast("int"))).otherwise(
        F.concat(F.element_at(tens, (F.floor(n / 10) + 1).cast("int")),
                 F.when(n % 10 != 0, F.concat(F.lit("-"), unit)).otherwise(F.lit(""))))


def _spell_below_1000(n: Column) -> Column:
    small = F.array(*[F.lit(w) for w in SMALL_NUMBERS])
    h, r = F.floor(n / 100), n % 100
    with_h = F.concat(F.element_at(small, (h + 1).cast("int")), F.lit(" hundred"),
                      F.when(r != 0, F.concat(F.lit(" and "), _spell_below_100(r))).otherwise(F.lit("")))
    return F.when(n >= 100, with_h).otherwise(_spell_below_100(n))


def spell_number(digits: Column) -> Column:
    """An all-digit token as English words ('one thousand, two hundred
    and thirty-four'), by groups of three digits, so of any length that number
    names reach (306 digits; the names end there, and longer tokens stay as they are)."""
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    size = F.ceil(F.length(plain) / 3).cast("int")
    padded = F.lpad(plain, size * 3, "0")
    values = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(padded, i * 3 + 1, F.lit(3)).cast("int"))
    # bound once: the spelling refers to the groups many times
    spelled = F.element_at(F.transform(F.array(values), _spelled), 1)
    named = digits.rlike("^[0-9]+$") & (F.length(plain) <= 3 * len(POWERS))
    return F.when(named, spelled).otherwise(digits)


def _spelled(groups: Column) -> Column:
    """Words of groups of three digits, highest first."""
    n = F.size(groups)
    powers = F.array(*[F.lit(p) for p in POWERS])
    high = F.filter(
        F.transform(F.slice(groups, F.lit(1), n - 1), lambda g, i: F.when(g != 0, F.concat(
            _spell_below_1000(g), F.lit(" "), F.get(powers, n - 1 - i)))), lambda w: w.isNotNull())
    head, last = F.array_join(high, ", "), F.element_at(groups, -1)
    return (F.when(n == 1, _spell_below_1000(last))
            .when(last == 0, head)
            .when(last < 100, F.concat(head, F.lit(" and "), _spell_below_100(last)))
            .otherwise(F.concat(head, F.lit(", "), _spell_below_1000(last))))


def word_syllables(word: Column) -> Column:
    """E2 + E3: numbers are spelled before the rule.

    The (possibly spelled) word is bound once as a lambda variable; the rule
    refers to it dozens of times and would otherwise copy the spelling
    expression into every reference."""
    return F.element_at(F.transform(F.array(spell_number(word)), syllable_rule), 1)
