"""Fill-in-middle: texts cut at two ranks of their tokens and put together anew."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import fresh

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
SPAN = 32
CHUNK = 1 << 18


def express_marks(text: str) -> tuple[int, np.ndarray]:
    """The number of units, and the code points at which every ``SPAN``-th unit begins, from unit 0 on; a long text is gone through in chunks."""
    units, inside, marks = 0, False, [np.zeros(0, np.int64)]
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le"), "<u4")
        letter = (codes | 0x20) - np.uint32(97) < 26
        before = np.concatenate([[inside], letter[:-1]])
        begin = np.flatnonzero(~(letter & before))
        marks.append(begin[-units % SPAN :: SPAN] + at)
        units, inside = units + len(begin), bool(letter[-1])
    return units, np.concatenate(marks)


class SkipList:
    """An indexable skip list over the units of a text, which is its lowest lane.

    A link of the first express lane spans ``SPAN`` units, one of each lane above it ``SPAN`` links of the lane below; the last link of a
    lane spans what is left. Every link has its width in units and in code points.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.units, marks = express_marks(text)
        lane = (np.diff(np.append(np.arange(len(marks)) * SPAN, self.units)), np.diff(np.append(marks, len(text))))
        self.lanes = [lane]
        while len(lane[0]) > SPAN:
            lane = tuple(np.add.reduceat(width, np.arange(0, len(width), SPAN)) for width in lane)
            self.lanes.append(lane)

    def code_points(self, rank: int) -> int:
        """How many code points the first ``rank`` units have: down the lanes, along each while the link does not go beyond the rank, then unit by unit."""
        units = points = link = 0
        for unit_width, point_width in reversed(self.lanes):
            while link < len(unit_width) and units + unit_width[link] <= rank:
                units, points, link = units + int(unit_width[link]), points + int(point_width[link]), link + 1
            link *= SPAN
        while units < rank:
            units, points = units + 1, UNIT.match(self.text, points).end()
        return points


def cut_places(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    rows = []
    for t, a, b in zip(text, h1, h2, strict=True):
        lanes = SkipList(t)
        low, high = sorted((int(a) % (lanes.units + 1), int(b) % (lanes.units + 1)))
        rows.append((lanes.units, lanes.code_points(low), lanes.code_points(high)))
    return pd.DataFrame(rows, columns=["n", "low", "high"], dtype="int64")


def fill_in_middle(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, suffix_first_percent: int = 20, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")
) -> DataFrame:
    """``df`` plus ``fim``: struct(n, form, prefix_chars, middle_chars, output).

    ``n`` counts units, ``[A-Za-z]+`` or any other one code point. Two ranks of units from 0 to ``n``, the form and whether a text is cut at all come
    from the digest of ``seed:key``. ``psm`` is prefix, suffix and middle, each behind its marker, ``spm`` suffix, prefix and middle; ``plain`` is the text as it is.
    Ranks become places in the text by an indexable skip list; the text never leaves its row, and only three numbers a row come back from Python.

    Edge cases: null counts as empty, and an empty text is plain; so is one in which a marker stands, as it could not be told from ours. Repeated rows get the same
    cut; a null key counts as an empty one. A text of one unit has a prefix or suffix or middle of all of it. An empty table gives no rows. A column ``fim`` is
    replaced, any other names are kept.
    """
    df = df.drop("fim")
    t, cut, low_, high_ = fresh(df, "_text", "_cut", "_low", "_high")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4))
    p, s, m = (F.lit(x) for x in markers)
    marked = F.contains(F.col(t), p) | F.contains(F.col(t), s) | F.contains(F.col(t), m)
    form = F.when((F.col(t) == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(cut, F.pandas_udf(cut_places, "n long, low long, high long")(F.col(t), h1, h2))
    out = out.withColumns({low_: F.col(cut)["low"].cast("int"), high_: F.col(cut)["high"].cast("int")})
    low, high, one = F.col(low_), F.col(high_), F.lit(1)
    prefix, middle, suffix = F.substr(F.col(t), one, low), F.substr(F.col(t), low + 1, high - low), F.substr(F.col(t), high + 1)
    output = F.when(form == "plain", F.col(t)).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    number = lambda c: F.when(form != "plain", c).cast("long")
    fim = F.struct(F.col(cut)["n"].alias("n"), form.alias("form"), number(low).alias("prefix_chars"), number(high - low).alias("middle_chars"), output.alias("output"))
    return out.withColumn("fim", fim).drop(t, cut, low_, high_)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text, exactly, from output and form alone: no text that is cut has a marker in it, and none arises where two parts meet."""
    parts = F.split(output, "|".join(re.escape(x) for x in markers))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
