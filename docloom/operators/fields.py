"""Formats, fields and flags of records, as Column expressions; selections by rank, row and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first bytes of the known formats, in hex, and the extensions that stand for them.
MAGIC = [("pdf", "255044462D"), ("hwp", "D0CF11E0A1B11AE1"), ("hwpx", "504B0304"), ("hwpx", "504B0506"), ("hwpx", "504B0708")]
EXTENSIONS = ("pdf", "hwp", "hwpx")
#: Weights of the five parts of a contribution score, each 0 to 4.
CONTRIBUTION = {"evidence": 0.30, "proximity": 0.25, "control": 0.20, "explanation": 0.15, "consistency": 0.10}


def extension_lower(path: Column) -> Column:
    """What stands after the last dot, if that is after the last slash; else empty."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def detect_format(content: Column, path: Column) -> Column:
    """By the first bytes, else by extension; null where neither is known."""
    start = F.hex(F.substring(content, 1, 8))
    by_bytes = F.coalesce(*[F.when(F.startswith(start, F.lit(magic)), name) for name, magic in MAGIC])
    return F.coalesce(by_bytes, F.when(extension_lower(path).isin(*EXTENSIONS), extension_lower(path)))


def is_meaningful(c: Column, letters: str = r"\x{AC00}-\x{D7A3}", digits: int = 6) -> Column:
    """At least two characters, and a letter of the class or so many digits."""
    return F.coalesce((F.length(c) >= 2) & (c.rlike(f"[{letters}]") | (F.length(F.regexp_replace(c, "[^0-9]+", "")) >= digits)), F.lit(False))


def language_drift(c: Column, least: int = 15, share: float = 0.6) -> Column:
    """A text of several words and at least so many characters besides spaces, of which that share or more are Latin letters."""
    solid = F.length(F.regexp_replace(c, "\\s+", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]+", ""))
    return F.coalesce((solid >= least) & F.contains(F.trim(c), F.lit(" ")) & (latin >= share * solid), F.lit(False))


def is_runaway(valid: Column, parsed: Column, tokens: Column, most: int, suspect: Column, ratio: float = 0.95) -> Column:
    """Neither valid nor parsed and close to the token limit, or suspect."""
    return F.coalesce(~valid & ~parsed & (tokens >= ratio * most), F.lit(False)) | F.coalesce(suspect, F.lit(False))


def first_filled(**sources: Column) -> Column:
    """(value, origin) of the first source that isn't blank; both null where all are."""
    picked = [F.when(F.trim(c) != "", F.struct(F.trim(c).alias("value"), F.lit(name).alias("origin"))) for name, c in sources.items()]
    return F.coalesce(*picked, F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("origin")))


def excludes(name: Column, patterns: list[str]) -> Column:
    """No pattern is in the name, whatever their case."""
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~F.contains(F.lower(name), F.lit(p.lower()))
    return keep


def without_escapes(c: Column) -> Column:
    """A log line without its terminal escapes."""
    return F.regexp_replace(c, r"\x{1B}\[[0-9;]*[A-Za-z]", "")


def unescape_xml(c: Column) -> Column:
    """Numeric references and the five named entities; & last, so that nothing is unescaped twice. A number that is no character stays as it is."""
    pattern = "&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"

    def character(m: Column) -> Column:
        code = F.when(F.regexp_like(m, F.lit("^&#[xX]")), F.conv(F.substring(m, 4, 8).substr(F.lit(1), F.length(m) - 4), 16, 10)).otherwise(F.substring(m, 3, 8).substr(F.lit(1), F.length(m) - 3)).cast("long")
        real = ((code == 9) | (code == 10) | (code == 13) | ((code >= 32) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))) & (code != 38)
        # a code point in four bytes of UTF-32, as char() knows the first 256 only
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code == 38, "&amp;").otherwise(m)

    both = F.transform(F.array(F.struct(F.split(c, pattern, -1).alias("p"), F.regexp_extract_all(c, F.lit(pattern), 0).alias("m"))), lambda s: F.concat(F.get(s["p"], F.lit(0)), F.array_join(F.zip_with(s["m"], F.slice(s["p"], 2, F.size(s["p"])), lambda m, r: F.concat(character(m), r)), "")))[0]
    c = F.when(F.contains(c, F.lit("&#")), both).otherwise(c)
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return c


def number_text(c: Column, decimals: int = 3) -> Column:
    """A number with so many decimals, halves to even; N/A for null and NaN."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), "N/A").otherwise(F.format_string(f"%.{decimals}f", F.bround(c.cast("double"), decimals)))


def model_family(name: Column, families: dict[str, str], default: str = "other", explicit: Column | None = None) -> Column:
    """The explicit family, else that of the first probe in the name."""
    c = F.lower(name)
    found = [F.when(F.contains(c, F.lit(probe)), family) for probe, family in families.items()]
    return F.coalesce(*([explicit] if explicit is not None else []), *found, F.lit(default))


def fuzzy_date(c: Column) -> Column:
    """``2023-07-08 13:30`` of the first 20YY and four numbers with loose separators; null where one is out of range."""
    gap = r"[^0-9]{1,4}"
    parts = [F.regexp_extract(c, f"(20[0-9]{{2}}){gap}([0-9]{{1,2}}){gap}([0-9]{{1,2}}){gap}([0-9]{{1,2}}){gap}([0-9]{{1,2}})", i).try_cast("int") for i in range(1, 6)]
    _, month, day, hour, minute = parts
    good = month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59)
    return F.when(good, F.format_string("%04d-%02d-%02d %02d:%02d", *parts))


def coordinate_suspect(c: Column) -> Column:
    """A minute or second of a degree over 59."""
    marks = F.regexp_extract_all(c, F.lit("([0-9]{1,3})\\s*['\"′″분초]"), 1)
    return F.coalesce(F.exists(marks, lambda x: x.cast("int") > 59), F.lit(False))


def contribution(**parts: Column) -> Column:
    """0 to 1 from the five parts, named as in CONTRIBUTION."""
    return sum((w * parts[name] for name, w in CONTRIBUTION.items()), F.lit(0.0)) / 4


def label_sets(df: DataFrame, group: str, label: str, allowed: list[str]) -> DataFrame:
    """(group, labels sorted, unknown: not allowed, missing: allowed and absent, common, every: labels and allowed, subset)."""
    known = F.array(*[F.lit(x) for x in sorted(allowed)])
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    unknown = F.array_except("labels", known)
    return sets.select(group, "labels", unknown.alias("unknown"), F.array_except(known, "labels").alias("missing"), F.array_intersect("labels", known).alias("common"), F.array_sort(F.array_union("labels", known)).alias("every"), (F.size(unknown) == 0).alias("subset"))


def within_budget(df: DataFrame, group: str, required: str, order: list, cost: Column, first_budget: int, budget: int, most: int) -> DataFrame:
    """Per group the best row of each required kind as far as first_budget goes, then ranked rows as far as budget goes, ``most`` in all.

    The first row that doesn't fit ends its pass. ``order`` must be total. Rows of a group are ordered in one task; a group is one question's candidates.
    """
    rows = df.withColumn("__cost", cost).withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    rows = rows.withColumn("__best", F.row_number().over(Window.partitionBy(group, required).orderBy("__rank")) == 1)
    upto = Window.partitionBy(group, "__best").orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__covers", F.col("__best") & (F.sum("__cost").over(upto) <= first_budget))
    rows = rows.withColumn("__spent", F.sum(F.when(F.col("__covers"), F.col("__cost")).otherwise(0)).over(Window.partitionBy(group))).withColumn("__n", F.count_if("__covers").over(Window.partitionBy(group)))
    later = Window.partitionBy(group, "__covers").orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.col("__spent") + F.sum("__cost").over(later) <= budget) & (F.col("__n") + F.row_number().over(Window.partitionBy(group, "__covers").orderBy("__rank")) <= most)
    rows = rows.withColumn("__fits", fits)
    return rows.where(F.col("__covers") | F.col("__fits")).select(*df.columns, F.col("__rank").alias("rank"), F.col("__covers").alias("covers"))


#: Fixed values of page layout: how far below its first an item begins a new row, in mean heights and at least; between which shares of a page's items its gutter lies, the
#: least share of their span that it is wide, and the least items of a page that has one.
ROW_HEIGHTS, ROW_LEAST = 0.6, 8.0
GUTTER_FROM, GUTTER_TO, GUTTER_WIDTH, GUTTER_ITEMS = 0.10, 0.65, 0.06, 6


def rows_by_height(items: Column, factor: float = ROW_HEIGHTS, least: float = ROW_LEAST) -> Column:
    """items: array of (y, height, ...) in order of y. The number of each item's row: a new one begins over max(factor * mean height, least) below its row's first."""
    mean = F.aggregate(items, F.lit(0.0), lambda s, x: s + x["height"]) / F.size(items)
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        new = s["first"].isNull() | (F.abs(x["y"] - s["first"]) > F.greatest(factor * mean, F.lit(least)))
        row = s["row"] + new.cast("int")
        return F.struct(F.when(new, x["y"]).otherwise(s["first"]).alias("first"), row.alias("row"), F.concat(s["rows"], F.array(row)).alias("rows"))

    return F.aggregate(items, start, step)["rows"]


def gutter(items: DataFrame, page: str, x: str, least_items: int = GUTTER_ITEMS) -> DataFrame:
    """(page, gutter): the middle of the widest gap between neighbouring x from 10 % to 65 % of the items, of at least 6 % of their span, with two on each side; else null."""
    w = Window.partitionBy(page)
    at = items.where(F.col(x).isNotNull()).select(page, F.col(x).cast("double").alias("x"), F.row_number().over(w.orderBy(x)).alias("i"), F.count(F.lit(1)).over(w).alias("n"), F.lag(F.col(x).cast("double")).over(w.orderBy(x)).alias("before"), (F.max(x).over(w) - F.min(x).over(w)).alias("span"))
    inside = (F.col("i") - 1 >= GUTTER_FROM * F.col("n")) & (F.col("i") - 1 <= GUTTER_TO * F.col("n")) & (F.col("i") > 2) & (F.col("n") - F.col("i") >= 1) & (F.col("n") >= least_items)
    wide = inside & (F.col("x") - F.col("before") >= GUTTER_WIDTH * F.col("span"))
    best = F.max(F.when(wide, F.struct((F.col("x") - F.col("before")).alias("gap"), (-F.col("i")).alias("i"), ((F.col("x") + F.col("before")) / 2).alias("middle"))))
    return at.groupBy(page).agg(best.getField("middle").alias("gutter"))
