"""Text normalisation of bank records, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Folds, word lists and patterns that decide results.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))
LEGAL_SUFFIXES = ("gmbh", "ag", "kg", "ohg", "ug", "se", "co", "ltd", "limited", "inc", "bv", "sa", "mbh", "kgaa", "ev")
PROCESSORS = r"(?iU)\b(?:visa|mastercard|maestro|paypal|klarna|sofort|sumup|adyen|stripe)\b"
LONG_DIGITS = r"(?U)\b\d{6,}\b"
IBAN_LIKE = r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
SEPA_REFERENCE = r"(?iU)\bSEPA[-\s]?(?:LASTSCHRIFT|UEBERWEISUNG)\b"
URL = r"(?U)https?://\S+"
INDUSTRIES = (
    ("Supermarkt", ("supermarkt", "lebensmittel", "rewe", "edeka", "aldi", "lidl", "penny", "netto", "kaufland")),
    ("Restaurant", ("restaurant", "gaststaette", "imbiss", "pizzeria", "cafe", "bar")),
    ("Gesundheit", ("apotheke", "drogerie", "klinik", "arzt", "praxis", "krankenhaus")),
    ("Verkehr", ("bahn", "bvg", "vbb", "mvg", "tankstelle", "shell", "aral", "esso")),
    ("Reisen", ("hotel", "pension", "airline", "lufthansa", "flughafen")),
    ("Streaming", ("netflix", "spotify", "amazon prime", "disney", "magenta tv", "sky")),
    ("Telekommunikation", ("telekom", "vodafone", "o2", "1&1")),
    ("Versorgung", ("strom", "stadtwerke", "gas", "wasser")),
    ("Versicherung", ("versicherung", "allianz", "axa", "huk")),
    ("Onlinehandel", ("paypal", "klarna", "amazon", "ebay")),
    ("Miete", ("vermieter", "miete", "wohnung")),
)
OTHER_INDUSTRY = "Sonstige"
LEGACY_INDUSTRIES = {
    "supermarket": "Supermarkt", "restaurant": "Restaurant", "health": "Gesundheit", "transport": "Verkehr", "travel": "Reisen", "streaming": "Streaming",
    "telco": "Telekommunikation", "utilities": "Versorgung", "insurance": "Versicherung", "marketplace": "Onlinehandel", "rent": "Miete", "other": OTHER_INDUSTRY,
}


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_umlauts(c: Column) -> Column:
    for a, b in UMLAUTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def punctuation_to_space(c: Column) -> Column:
    """All but letters, numbers and white space become spaces."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", " ")


def normalize_counterparty(c: Column) -> Column:
    """A stable key for a payee's name: lower case without umlauts, punctuation, long numbers, payment processors and legal forms."""
    s = punctuation_to_space(F.lower(fold_umlauts(collapse_spaces(or_empty(c)))))
    s = F.regexp_replace(F.regexp_replace(s, LONG_DIGITS, " "), PROCESSORS, " ")
    drop = F.array(*[F.lit(x) for x in ("", *LEGAL_SUFFIXES)])
    return F.array_join(F.filter(F.split(s, r"(?U)\s+"), lambda t: ~F.array_contains(drop, t)), " ")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, which has no built-in function; a Python function on Arrow batches, for texts with non-ASCII characters alone."""

    def compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    other = F.when(c.rlike("[^\\x00-\\x7F]"), c)
    return F.coalesce(F.pandas_udf(compose, "string", F.PandasUDFType.SCALAR_ITER)(other), c)


def normalize_memo(c: Column, *, compose: bool = True) -> Column:
    """The memo's wording, composed (NFKC), without links, account numbers, SEPA marks, long numbers and punctuation.

    ``compose`` false leaves composition out, and Python with it, where the input is composed already.
    """
    s = fold_umlauts(F.trim(nfkc(or_empty(c)) if compose else or_empty(c)))
    for pattern in (URL, IBAN_LIKE, SEPA_REFERENCE, LONG_DIGITS):
        s = F.regexp_replace(s, pattern, " ")
    return collapse_spaces(punctuation_to_space(F.lower(s)))


def combined_text(counterparty: Column, memo: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(or_empty(counterparty), F.lit("")), F.nullif(or_empty(memo), F.lit("")))


def simplify_paypal_memo(memo: Column, payer: Column, payee: Column) -> Column:
    """``Ihr Einkauf bei X`` becomes X where payer or payee is the processor."""
    shop = F.trim(F.regexp_extract(or_empty(memo), r"(?is)Ihr\s+Einkauf\s+bei\s+(.+)$", 1))
    theirs = F.lower(or_empty(payer)).contains("paypal") | F.lower(or_empty(payee)).contains("paypal")
    return F.when(theirs & (shop != ""), shop).otherwise(memo)


def counterparty_of(payee: Column, payer: Column) -> Column:
    """The payee, or the payer where there is none."""
    return F.coalesce(F.nullif(payee, F.lit("")), payer)


def secondary_memo(name: Column, email: Column) -> Column:
    name, email = F.trim(or_empty(name)), F.trim(or_empty(email))
    return F.when(email != "", F.concat(name, F.lit(" ("), email, F.lit(")"))).otherwise(name)


def long_tokens(c: Column, least: int = 4) -> Column:
    """Distinct lower-case words of ``least`` characters or more."""
    words = F.regexp_extract_all(F.lower(or_empty(c)), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda x: F.length(x) >= least))


def overlap_bonus(a: Column, b: Column, per_token: float = 0.05, most: float = 0.15) -> Column:
    return F.least(F.lit(most), F.lit(per_token) * F.size(F.array_intersect(a, b)))


def heuristic_industry(counterparty: Column, summary: Column | None = None) -> Column:
    """The first industry one of whose keywords is part of the name or summary."""
    blob = F.lower(F.concat(or_empty(counterparty), F.lit(" "), or_empty(summary) if summary is not None else F.lit("")))
    out = F.lit(OTHER_INDUSTRY)
    for label, words in reversed(INDUSTRIES):
        test = blob.contains(words[0])
        for w in words[1:]:
            test = test | blob.contains(w)
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def translate_industry(c: Column) -> Column:
    """Old English labels in German; others unchanged; null is empty."""
    table = F.create_map(*[F.lit(x) for kv in LEGACY_INDUSTRIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), c, F.lit(""))


def is_meaningful_industry(c: Column) -> Column:
    return ~F.lower(F.trim(or_empty(c))).isin("sonstige", "other", "")


def premise(text: Column, industry: Column, summary: Column, most: int = 200) -> Column:
    """What a zero-shot scorer reads: text, branch and a summary cut at a word's end, each as a sentence where not empty."""
    base, ind, whole = F.trim(or_empty(text)), F.trim(or_empty(industry)), F.trim(or_empty(summary))
    cut = F.substring(whole, 1, most)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))  # characters before the last space
    cut = F.when(cut.contains(" ") & (last > most * 0.6), F.substring(cut, F.lit(1), last)).otherwise(cut)
    short = F.when(F.length(whole) > most, F.concat(F.regexp_replace(cut, r"[ ,.;:]+\z", ""), F.lit("…"))).otherwise(whole)
    first = F.when(base == "", None).when(base.endswith("."), base).otherwise(F.concat(base, F.lit(".")))
    return F.trim(F.concat_ws(" ", first, F.when(ind != "", F.concat(F.lit("Branche: "), ind, F.lit("."))), F.when(short != "", short)))


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits per character of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        hit = v & places.get(ch, 0)
        v = (v + hit | v - hit) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence in both lengths; two empty strings are alike."""
    return 200.0 * longest_common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: how alike two names are as sets of words; the best of shared words against each side and the sides against each other.

    Likeness of two strings counts insertions and deletions only, for which there is no built-in function. Names of which one has all words
    of the other are 100 without it.
    """
    ta, tb = (F.array_sort(F.array_distinct(F.split(F.trim(x), r"\s+"))) for x in (a, b))
    both, only_a, only_b = F.array_intersect(ta, tb), F.array_except(ta, tb), F.array_except(tb, ta)
    s0 = F.array_join(both, " ")
    s1, s2 = (F.trim(F.concat_ws(" ", s0, F.array_join(x, " "))) for x in (only_a, only_b))

    def best(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, z in parts:
            yield pd.Series([max(indel_ratio(p, q) if p else 0.0, indel_ratio(p, r) if p else 0.0, indel_ratio(q, r)) if q is not None and r is not None else None for p, q, r in zip(x, y, z, strict=True)], dtype="float64")

    inside = (F.size(both) > 0) & ((F.size(only_a) == 0) | (F.size(only_b) == 0))
    return F.when(inside, 100.0).otherwise(F.pandas_udf(best, "double", F.PandasUDFType.SCALAR_ITER)(s0, s1, s2))
