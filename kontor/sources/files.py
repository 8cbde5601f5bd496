"""Directories of export files: decoding, header search, and records by column name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.functions import amounts, dates, text
from kontor.scratch import scratch_table

SNIFFED = 4096
# Fixed value: a record is what stands between line breaks outside quotes.
RECORD = r'(?:[^"\r\n]++|"[^"]*+(?:""[^"]*+)*+"?)++'


def bank_header(c: Column) -> Column:
    """A header cell as a key: lower case, no gender marks, umlauts or currency, underscores for blanks and hyphens."""
    s = F.lower(F.trim(c))
    s = F.replace(F.replace(s, F.lit("*r"), F.lit("r")), F.lit("*in"), F.lit(""))
    s = F.trim(F.regexp_replace(text.fold_umlauts(s), r" ?\(€\)", ""))
    return F.translate(s, "- ", "__")


def activity_header(c: Column) -> Column:
    return F.replace(text.fold_umlauts(F.lower(F.trim(c))), F.lit(" "), F.lit("_"))


@dataclass(frozen=True)
class SourceSpec:
    """A kind of export: its name, its header cells' keys, the columns that mark its header row, the first of them if it begins the row, the separators it may use and which transactions its records may match.

    The last of the required columns has no letters that keys are folded to, so that a cell with its key is that word, but for case and blanks around it.
    """

    name: str
    header: Callable[[Column], Column]
    required: tuple[str, ...]
    first: str | None
    separators: tuple[str, ...]
    keyword: str | None = None


BANK = SourceSpec("bank", bank_header, ("buchungsdatum", "betrag", "verwendungszweck"), "buchungsdatum", (";",))
PAYPAL = SourceSpec("paypal", activity_header, ("datum", "name", "netto", "transaktionscode"), None, (",", ";", "\t"), "paypal")
SPECS = (BANK, PAYPAL)


def decode(content: Column) -> Column:
    """UTF-8 with or without a mark, else Windows-1252, else Latin-1: Spark's own decoder has no Windows-1252."""

    def one(b: bytes) -> str:
        for name in ("utf-8-sig", "cp1252"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("latin-1")

    def all_of(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in contents:
            yield s.map(one)

    return F.pandas_udf(all_of, "string", F.PandasUDFType.SCALAR_ITER)(content)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): whole files by path, as exports are small; their number is what grows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), decode(F.col("content")).alias("content"))


# What Windows-1252 has in place of 27 control characters of Latin-1, and the five bytes that it has not.
CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
WINDOWS = "".join(bytes([ord(c)]).decode("cp1252") for c in CONTROLS)
UNASSIGNED = "[\\x81\\x8D\\x8F\\x90\\x9D]"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, pos, line): the records of all files under ``path``, however large a file is; takes the place of :func:`read_files`.

    A file is read by as many tasks as Spark cuts it into splits. A split counts the quotes of its lines; the parity of all quotes before it, added up over the splits, tells for each line
    whether it begins within a quoted cell. Lines that are records by themselves stay as they are; only those within which a cell goes on meet, record by record. The encoding is
    decided over the whole file as in :func:`decode`: UTF-8 if every line is, else Windows-1252 unless one of its unassigned bytes occurs. ``head``: the file's first characters. Line
    breaks within a cell become ``\\n``.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))
    latin = F.decode("bytes", "ISO-8859-1")
    utf8 = F.is_valid_utf8(F.col("bytes").cast("string"))
    lines = lines.withColumn("odd", F.regexp_count(latin, F.lit('"')) % 2)
    of_file, before_me = Window.partitionBy("file"), Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = lines.groupBy("file", "split").agg(F.sum("odd").alias("odd"), F.min(utf8).alias("utf8"), F.max(~utf8 & latin.rlike(UNASSIGNED)).alias("unassigned"))
    splits = splits.select("file", "split", (F.coalesce(F.sum("odd").over(before_me), F.lit(0)) % 2).alias("inside"), F.min("utf8").over(of_file).alias("utf8"), F.max("unassigned").over(of_file).alias("unassigned"))
    here = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    content = F.when(F.col("utf8"), F.regexp_replace(F.col("bytes").cast("string"), "^\ufeff", "")).when(F.col("unassigned"), latin).otherwise(F.translate(latin, CONTROLS, WINDOWS))
    goes_on = (F.col("inside") + F.sum("odd").over(here) - F.col("odd")) % 2 == 1
    lines = lines.join(scratch_table(splits, "file-splits"), ["file", "split"]).select("file", "split", "at", "odd", goes_on.alias("goes_on"), content.alias("line"))
    starts = F.sum((~F.col("goes_on") & (F.col("line") != "")).cast("long")).over(here)
    lines = scratch_table(lines.withColumn("starts", starts), "file-lines")
    counts = lines.groupBy("file", "split").agg(F.max("starts").alias("k")).select("file", "split", F.coalesce(F.sum("k").over(before_me), F.lit(0)).alias("before"))
    lines = lines.join(scratch_table(counts, "file-starts"), ["file", "split"]).withColumn("pos", F.col("before") + F.col("starts") - 1)
    # an even number of quotes in a line that begins outside of a cell: the line is a record; all others are parts of one
    alone = ~F.col("goes_on") & (F.col("odd") == 0)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", c.alias("line")))), lambda p: p["line"]), "\n")
    pieces = lines.where(~alone).groupBy("file", "pos").agg(in_order(F.col("line")).alias("line"))
    heads = lines.where((F.col("split") == 0) & (F.col("starts") <= 64)).groupBy("file").agg(F.substring(in_order(F.substring("line", 1, SNIFFED)), 1, SNIFFED).alias("head"))
    every = lines.where(alone & (F.col("line") != "")).select("file", "pos", "line").unionByName(pieces)
    return every.join(heads, "file", "left").select("file", F.coalesce("head", F.lit("")).alias("head"), F.col("pos").cast("int").alias("pos"), "line")


def separator(content: Column, candidates: tuple[str, ...]) -> Column:
    """The candidate that occurs most often in the file's beginning, the first of equals."""
    head = F.substring(content, 1, SNIFFED)
    counts = [F.length(head) - F.length(F.replace(head, F.lit(x), F.lit(""))) for x in candidates]
    out = F.lit(candidates[-1])
    for i in range(len(candidates) - 2, -1, -1):
        best = counts[i + 1]
        for c in counts[i + 2 :]:
            best = F.greatest(best, c)
        out = F.when(counts[i] >= best, F.lit(candidates[i])).otherwise(out)
    return out


def cells(line: Column, sep: Column) -> Column:
    """A record as an array of its cells, however many; quotes and doubled quotes are undone."""
    quoted = r'"[^"]*+(?:""[^"]*+)*+"?'
    found = F.regexp_extract_all(F.concat(sep, line), F.concat(sep, F.lit(f"({quoted}|[^"), sep, F.lit("]*+)")), 1)
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - F.when(c.endswith('"') & (F.length(c) > 1), 2).otherwise(1))
    return F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(inner(c), F.lit('""'), F.lit('"'))).otherwise(c))


def every_record(files: DataFrame, spec: SourceSpec) -> DataFrame:
    """(file, pos, cells) of all records; they may hold line breaks within quotes."""
    if "line" in files.columns:
        lines = files.select("file", separator(F.col("head"), spec.separators).alias("sep"), "pos", "line")
    else:
        # the separator is found once a file: beside the records, not behind them, where every record would carry the whole file with it
        whole = files.select("file", separator(F.col("content"), spec.separators).alias("sep"), F.regexp_extract_all("content", F.lit(RECORD), 0).alias("lines"))
        lines = whole.select("file", "sep", F.posexplode("lines").alias("pos", "line"))
    return lines.select("file", "pos", cells(F.col("line"), F.col("sep")).alias("cells"))


def not_blank(rows: DataFrame) -> DataFrame:
    return rows.where(F.exists("cells", lambda c: F.trim(c) != ""))


def parsed(files: DataFrame, spec: SourceSpec) -> DataFrame:
    """(file, pos, cells) of the records that are not blank."""
    return not_blank(every_record(files, spec))


def parsed_once(files: DataFrame, spec: SourceSpec) -> DataFrame:
    """:func:`parsed`, written out: headers, rows and files without a header all follow from it, and each file is read and cut into cells once."""
    return not_blank(scratch_table(every_record(files, spec), "file-cells"))


def headers(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """(file, head, keys): the first row of each file that has the spec's required columns (for banks: that begins with its first column), wherever it stands."""
    keys = F.transform("cells", spec.header)
    # what most rows fail comes first and is cheap: all keys are made of few rows
    likely = F.exists("cells", lambda c: F.lower(F.trim(c)) == spec.required[-1]) if spec.first is None else spec.header(F.get("cells", F.lit(0))) == spec.first
    test = F.when(likely, F.size(F.array_except(F.array(*[F.lit(x) for x in spec.required]), keys)) == 0)
    head = rows.where(test).groupBy("file").agg(F.min_by(F.struct(F.col("pos").alias("head"), keys.alias("keys")), "pos").alias("h"))
    return head.select("file", "h.*")


def records(files: DataFrame, spec: SourceSpec, rows: DataFrame | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(file, row, record): the rows below each file's header as maps from column key to cell, of all columns or of ``columns`` alone; ``rows``: :func:`parsed_once` of the files.

    Blank rows go, short rows are filled up, what stands beyond the header goes; of columns with one key the last counts. Which columns count is found once a file.
    """
    rows = parsed_once(files, spec) if rows is None else rows
    last = lambda k, i: F.coalesce(k != "", F.lit(False)) & ~F.array_contains(F.slice("keys", i + 2, F.greatest(F.size("keys"), F.lit(1))), k)
    asked = lambda k: F.lit(True) if columns is None else k.isin(*columns)
    place = F.filter(F.transform("keys", lambda k, i: F.when(asked(k) & last(k, i), i)), lambda i: i.isNotNull())
    heads = headers(rows, spec).select("file", "head", "keys", place.alias("places")).select("file", "head", "places", F.transform("places", lambda i: F.get("keys", i)).alias("names"))
    found = rows.join(scratch_table(heads, "file-heads"), "file").where("pos > head")
    return found.select("file", (F.col("pos") - F.col("head")).alias("row"), F.map_from_arrays("names", F.transform("places", lambda i: F.coalesce(F.get("cells", i), F.lit("")))).alias("record"))


def without_header(files: DataFrame, spec: SourceSpec, rows: DataFrame | None = None) -> DataFrame:
    """(file) of the files that are not empty and have no header of the spec."""
    rows = parsed_once(files, spec) if rows is None else rows
    return rows.select("file").distinct().join(headers(rows, spec), "file", "left_anti")


def classify_files(files: DataFrame) -> DataFrame:
    """(file, kind, n_kinds): which spec's header a file has; ``kind`` is null unless exactly one fits."""
    tests = [headers(every_record(files, s), s).select("file", F.lit(s.name).alias("kind")) for s in SPECS]
    kinds = tests[0].unionByName(tests[1]).groupBy("file").agg(F.collect_set("kind").alias("k"))
    return files.select("file").distinct().join(kinds, "file", "left").select("file", F.when(F.size("k") == 1, F.col("k")[0]).alias("kind"), F.coalesce(F.size("k"), F.lit(0)).alias("n_kinds"))


def get(name: str) -> Column:
    return F.coalesce(F.try_element_at("record", F.lit(name)), F.lit(""))


BANK_COLUMNS = ("buchungsdatum", "wertstellung", "status", "zahlungspflichtiger", "zahlungsempfaenger", "verwendungszweck", "umsatztyp", "iban", "betrag", "glaeubiger_id", "mandatsreferenz", "kundenreferenz")


def bank_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of bank exports, and the rejects (file, row, reason); a file without a header is one reject, of row 0."""
    cells_of = parsed_once(files, BANK)
    r = records(files, BANK, cells_of, BANK_COLUMNS)
    clean = lambda c: text.collapse_spaces(get(c))
    day, cents = dates.parse_german_date(get("buchungsdatum")), amounts.to_cents(amounts.parse_german_amount(get("betrag")))
    value = dates.parse_german_date(get("wertstellung"))
    p = r.select(
        F.col("file").alias("source_file"), F.col("row").alias("source_row"), day.alias("date"), value.alias("value_date"), clean("status").alias("status"), clean("zahlungspflichtiger").alias("payer"), clean("zahlungsempfaenger").alias("payee"),
        clean("verwendungszweck").alias("memo"), clean("umsatztyp").alias("kind"), F.replace(F.trim(get("iban")), F.lit(" "), F.lit("")).alias("iban"), cents.alias("cents"), clean("glaeubiger_id").alias("creditor"), clean("mandatsreferenz").alias("mandate"), clean("kundenreferenz").alias("reference"),
        F.when(day.isNull(), "bad or missing date").when(cents.isNull(), "bad or missing amount").when((F.trim(get("wertstellung")) != "") & value.isNull(), "bad value date").alias("reason"),
    )
    p = scratch_table(p, "bank-rows")  # rows and rejects are parts of it
    no_header = without_header(files, BANK, cells_of).select(F.col("file").alias("source_file"), F.lit(0).alias("source_row"), F.lit("no header").alias("reason"))
    return p.where("reason is null").drop("reason"), p.where("reason is not null").select("source_file", "source_row", "reason").unionByName(no_header)


def whole_files_only(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """The strict policy: files with a reject give nothing."""
    return rows.join(rejects.select("source_file").distinct(), "source_file", "left_anti")


def activity_rows(files: DataFrame) -> DataFrame:
    """Records of a payment service's activity export; rows without reference, name, date or amount are skipped."""
    r = records(files, PAYPAL)
    day, cents = dates.parse_german_date(get("datum")), amounts.to_cents(amounts.parse_german_amount(get("netto")))
    out = r.select("file", "row", day.alias("txn_date"), cents.alias("cents"), F.trim(get("name")).alias("counterparty"), text.secondary_memo(get("name"), get("absender_e-mail-adresse")).alias("description"), F.trim(get("transaktionscode")).alias("ref"))
    return scratch_table(out, "activity-rows").where("txn_date is not null and cents is not null and counterparty <> '' and ref <> ''")
