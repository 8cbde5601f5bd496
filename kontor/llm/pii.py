"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in built-in functions.

Found values are validated (checksums, ranges, calendar), then permuted within their own format under a key: digits stay
digits in their places, letters letters, addresses stay addresses and dates dates, and check digits are made
anew. The permutation is a bijection on each format, so that equal values have equal pseudonyms in all
documents, and different ones different.

Numbers are permuted as two halves, each in turn moved by a keyed hash of the other; every round is a column of its own, so that it is compiled
and computed once. Each distinct value is permuted once, and joined back to where it stands.
"""

from __future__ import annotations

import hashlib
import hmac
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import fresh, scratch_table

ROUNDS = 8

# What is looked for, each with the test that a match must pass (below).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
SECRET = r"(?<![A-Za-z0-9])(?:token|secret|password|api[_-]?key|TOKEN|SECRET|PASSWORD|API[_-]?KEY)\s{0,3}[=:]\s{0,3}[\"']?(?:[0-9a-f]{16,}+|[0-9A-F]{16,}+)(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
ISO_DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])"
DOT_DATE = r"(?<![0-9.])[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, SECRET, ADDRESS, PHONE, SOCIAL, ISO_DATE, DOT_DATE, CARD))
SOME = "[0-9@=:]"  # no match is without one of these
PHONE_PARTS = r"^(\+1[ .-]?\(?)([0-9]{3})(\)?[ .-]?)([0-9]{3})([ .-]?)([0-9]{4})$"
CARD_DIGITS = 19


def round_hash(key: str, kind: str, i: int, *parts: Column) -> Column:
    """64 hex digits of a keyed hash of the round and ``parts``."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(i)), *[p.cast("string") for p in parts]), 256)


def feistel_number(df: DataFrame, left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> DataFrame:
    """``df`` plus ``left`` and ``right``: the pair (below the sizes) permuted; sizes must not depend on what is permuted."""
    df = df.withColumns({"left": left.cast("long"), "right": right.cast("long"), "left_size": left_size.cast("long"), "right_size": right_size.cast("long")})
    for i in range(ROUNDS):
        mine, other = ("left", "right") if i % 2 == 0 else ("right", "left")
        move = F.conv(F.substring(round_hash(key, kind, i, F.col("left_size"), F.col("right_size"), F.col(other)), 1, 14), 16, 10).cast("long")  # below 2**56
        df = df.withColumn(mine, F.pmod(F.col(mine) + move, F.col(f"{mine}_size")))
    return df


def feistel_text(df: DataFrame, value: Column, key: str, kind: str, *, hexadecimal: bool) -> DataFrame:
    """``df`` plus ``moved``: ``value`` with each digit and letter moved within its alphabet (of lower-case hexadecimal numbers, that of all their digits)."""
    half = F.floor(F.length(value) / 2).cast("int")
    df = df.withColumns({"left": F.substring(value, F.lit(1), half), "right": F.substring(value, half + 1, F.length(value) - half)})
    hexes = "0123456789abcdef"

    def shift(c: Column, h: Column) -> Column:
        by, code, out = F.conv(h, 16, 10).cast("int"), F.ascii(c), c
        if hexadecimal:
            return F.substring(F.lit(hexes), F.pmod(F.instr(F.lit(hexes), c) - 1 + by, F.lit(16)) + 1, F.lit(1))
        for first, size in ((48, 10), (65, 26), (97, 26)):
            out = F.when((code >= first) & (code < first + size), F.char(first + F.pmod(code - first + by, F.lit(size)))).otherwise(out)
        return out

    for i in range(ROUNDS):
        mine, other = (F.col(c) for c in (("left", "right") if i % 2 == 0 else ("right", "left")))
        n = F.length(mine)
        stream = F.repeat(F.concat(*[round_hash(key, kind, i, F.lit(j), other) for j in range(4)]), F.ceil(n / 64).cast("int"))  # four hex digits a character
        moves = F.slice(F.regexp_extract_all(stream, F.lit("[0-9a-f]{4}"), 0), F.lit(1), n)
        df = df.withColumn("left" if i % 2 == 0 else "right", F.when(n > 0, F.array_join(F.zip_with(F.split(mine, ""), moves, shift), "")).otherwise(mine))
    return df.withColumn("moved", F.concat("left", "right"))


def luhn_sum(digits: Column) -> Column:
    """The checksum of a number whose last digit is the check digit: every second digit from the right doubled, and nines cast out."""
    back = F.reverse(digits)
    total = F.lit(0)
    for j in range(CARD_DIGITS):
        d = F.coalesce(F.nullif(F.substring(back, j + 1, 1), F.lit("")).cast("int"), F.lit(0))
        total = total + (d if j % 2 == 0 else F.element_at(F.array(*[F.lit(2 * x - 9 if x > 4 else 2 * x) for x in range(10)]), d + 1))
    return total


def dress(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by ``digits``."""

    def one(j: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(template, F.lit(1), j), "[^0-9]", ""))
        c = F.substring(template, j, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.when(template.rlike("^[0-9]+$"), digits).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), one), ""))


KINDS = ("email", "secret", "address", "phone", "social", "date", "card")


def value_kind(m: Column) -> Column:
    """The kind of a match, null if it is not valid."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = [F.substring_index(F.substring_index(m, ".", i + 1), ".", -1).cast("int") for i in range(4)]
    in_range = reduce(lambda a, b: a & b, [o <= 255 for o in octets])
    iso = F.try_to_timestamp(F.when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), m), F.lit("yyyy-MM-dd")).isNotNull()
    dotted = F.try_to_timestamp(F.when(m.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), m), F.lit("dd.MM.yyyy")).isNotNull()
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("[=:]"), "secret")
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(in_range, "address"))
        .when(m.startswith("+"), "phone")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
        .when(iso | dotted, "date")
        .when(m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$"), "card")
    )


def pseudonyms(values: DataFrame, key: str) -> DataFrame:
    """(value, new) of ``values`` (value, kind): each permuted as its kind asks."""
    m, digits, out = F.col("value"), F.regexp_replace("value", "[^0-9]", ""), []
    of = {k: values.where(F.col("kind") == k).select("value") for k in KINDS}

    local = F.substring_index(m, "@", 1)
    rest = F.substring(m, F.length(local) + 1, F.length(m))
    out.append(feistel_text(of["email"], local, key, "email", hexadecimal=False).select("value", F.concat("moved", rest).alias("new")))

    hexed, head = F.regexp_extract(m, "([0-9A-Fa-f]+)$", 1), F.regexp_extract(m, "^(.*?)[0-9A-Fa-f]+$", 1)
    secret = of["secret"].withColumns({"head": head, "hexed": hexed})
    secret = feistel_text(secret, F.lower("hexed"), key, "secret", hexadecimal=True)
    out.append(secret.select("value", F.concat("head", F.when(F.col("hexed") == F.lower("hexed"), F.col("moved")).otherwise(F.upper("moved"))).alias("new")))

    octets = [F.substring_index(F.substring_index(m, ".", i + 1), ".", -1).cast("long") for i in range(4)]
    quad = feistel_number(of["address"], octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, "address")
    parts = [x for c in ("left", "right") for x in (F.shiftright(c, 8), F.col(c) % 256)]
    out.append(quad.select("value", F.concat_ws(".", *[p.cast("string") for p in parts]).alias("new")))

    # area and exchange keep whether they begin with 2 to 9, as valid ones do
    p = [F.regexp_extract(m, PHONE_PARTS, i) for i in range(1, 7)]
    size = lambda part: F.when(part >= "2", 800).otherwise(200)
    start = lambda part: F.when(part >= "2", 200).otherwise(0)
    area, exchange = p[1].cast("long") - start(p[1]), p[3].cast("long") - start(p[3])
    phone = feistel_number(of["phone"], area * size(p[3]) + exchange, p[5], size(p[1]) * size(p[3]), F.lit(10000), key, "phone")
    new_area, new_exchange = F.floor(F.col("left") / size(p[3])) + start(p[1]), F.col("left") % size(p[3]) + start(p[3])
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    out.append(phone.select("value", F.concat(p[0], pad(new_area, 3), p[2], pad(new_exchange, 3), p[4], pad(F.col("right"), 4)).alias("new")))

    area, group, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    area = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas: 1 to 899 without 666
    social = feistel_number(of["social"], area, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "social")
    new_area = F.when(F.col("left") >= 665, F.col("left") + 2).otherwise(F.col("left") + 1)
    out.append(social.select("value", F.concat_ws("-", pad(new_area, 3), pad(F.floor(F.col("right") / 9999) + 1, 2), pad(F.col("right") % 9999 + 1, 4)).alias("new")))

    first, iso = F.to_date(F.lit("1900-01-01")), m.contains("-")
    day = F.datediff(F.when(iso, F.to_date(m, "yyyy-MM-dd")).otherwise(F.to_date(F.when(~iso, m), "dd.MM.yyyy")), first)
    # 17 * 4297 = 73049 days, to 2099-12-31
    date = feistel_number(of["date"], F.floor(day / 4297), day % 4297, F.lit(17), F.lit(4297), key, "date").withColumn("day", F.date_add(first, (F.col("left") * 4297 + F.col("right")).cast("int")))
    out.append(date.select("value", F.when(iso, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "dd.MM.yyyy")).alias("new")))

    n = F.length(digits) - 1
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    card = feistel_number(of["card"], F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half), ten(half), ten(n - half), key, "card")
    card = card.withColumn("payload", F.concat(F.lpad(F.col("left").cast("string"), half, F.lit("0")), F.lpad(F.col("right").cast("string"), n - half, F.lit("0"))))
    card = card.withColumn("number", F.concat("payload", F.pmod(-luhn_sum(F.concat("payload", F.lit("0"))), F.lit(10)).cast("string")))
    out.append(card.select("value", dress(m, F.col("number")).alias("new")))
    return reduce(DataFrame.unionByName, out)


def pseudonymise(df: DataFrame, key: str, *, text: str = "text", stable_input: bool = False) -> DataFrame:
    """``df`` with the personal data in ``text`` replaced, plus ``pii`` (map of kind to number of values replaced) and ``n_pii`` (long).

    Found and validated: payment cards (13 to 19 digits, Luhn), phone numbers of country code 1, social security numbers, IPv4
    addresses, dates of 1900 to 2099 (ISO and dotted), e-mail addresses (the local part changes, the domain stays) and hexadecimal secrets after their name. What
    is not valid stays. Equal values become equal pseudonyms under one ``key``, whatever stands between their digits; a value may be its own
    pseudonym with the chance of any other. ``key`` itself stays on the driver; a subkey derived from it is in the plan, and whoever reads
    the plan can repeat this operator's pseudonyms.

    Built-in functions only. Two passes over the texts, one to find and one to replace; distinct values are permuted once, and what a
    text's matches become is joined to it by row number. ``stable_input``: ``df`` reads files, and each partition gives the same rows again; else it
    is written to the shared scratch folder first.

    Edge cases: null stays null and empty empty, with n_pii 0; repeated rows change alike; an empty table gives no rows;
    existing columns ``pii`` and ``n_pii`` are replaced, and any other names are kept.
    """
    subkey = hmac.new(key.encode(), b"pseudonyms", hashlib.sha256).hexdigest()
    df = df.drop("pii", "n_pii")
    if not stable_input:
        df = scratch_table(df, "pii-input")
    row, found = fresh(df, "_row", "_found")
    rows = df.withColumn(row, F.monotonically_increasing_id())
    matches = F.when(F.col(text).rlike(SOME), F.regexp_extract_all(text, F.lit(ANY), 0))
    hits = scratch_table(rows.select(F.col(row).alias("row"), F.posexplode(matches).alias("place", "value")), "pii-hits")
    values = scratch_table(hits.select("value").distinct().withColumn("kind", value_kind(F.col("value"))), "pii-values")
    known = values.join(pseudonyms(values.where("kind is not null"), subkey), "value", "left")
    named = hits.join(known, "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "kind", F.coalesce("new", "value").alias("new")))).alias(found))
    named = scratch_table(named.withColumnRenamed("row", row), "pii-named")
    out = rows.join(named.hint("merge"), row, "left")  # one plan at every size
    parts = F.zip_with(F.split(text, ANY, -1), F.transform(found, lambda x: x["new"]), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    kinds = F.filter(F.transform(found, lambda x: x["kind"]), lambda k: k.isNotNull())

    def number_of(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(kinds, lambda x: x == kind)), F.lit(0)).cast("long")

    n = {k: F.when(F.col(found).isNotNull(), number_of(k)).otherwise(F.lit(0).cast("long")) for k in KINDS}
    out = out.withColumn("pii", F.create_map(*[c for k in KINDS for c in (F.lit(k), n[k])])).withColumn("n_pii", F.when(F.col(found).isNotNull(), F.size(kinds)).otherwise(0).cast("long"))
    changed = F.when(F.col(found).isNotNull(), F.array_join(parts, "")).otherwise(F.col(text))
    return out.withColumn(text, changed).select(*df.columns, "pii", "n_pii")
