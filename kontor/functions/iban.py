"""IBANs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths by country, as registered.
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def clean(c: Column) -> Column:
    return F.upper(F.replace(F.trim(c), F.lit(" "), F.lit("")))


def mod97(cleaned: Column) -> Column:
    """The remainder of the number that the rearranged IBAN spells, letters as 10 to 35: letters replaced, then six digits at a time."""
    turned = F.concat(F.substring(cleaned, F.lit(5), F.length(cleaned)), F.substring(cleaned, 1, 4))
    for i in range(26):
        turned = F.replace(turned, F.lit(chr(65 + i)), F.lit(str(10 + i)))
    pieces = F.regexp_extract_all(turned, F.lit("[0-9]{1,6}"), 0)
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda r, p: (r * F.pow(F.lit(10.0), F.length(p)).cast("long") + p.cast("long")) % 97)


def is_valid(cleaned: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for kv in LENGTHS.items() for x in kv])
    shaped = cleaned.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.length(cleaned) == F.try_element_at(lengths, F.substring(cleaned, 1, 2)))
    return F.coalesce(shaped & F.when(shaped, mod97(cleaned) == 1), F.lit(False))


def classify(c: Column) -> dict[str, Column]:
    """country, bank code (German and valid), validity and whether foreign; a country needs two letters, valid or not."""
    x = clean(c)
    country = F.when(F.substring(x, 1, 2).rlike("^[A-Z]{2}$"), F.substring(x, 1, 2))
    valid = is_valid(x)
    return {
        "iban_country": country, "iban_blz": F.when(valid & (country == "DE"), F.substring(x, 5, 8)), "iban_is_valid": valid.cast("int"),
        "iban_is_foreign": F.when(F.nullif(x, F.lit("")).isNotNull(), (F.coalesce(country, F.lit("DE")) != "DE").cast("int")),
    }
