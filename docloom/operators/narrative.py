"""Reports read line by line: what happened, an overview, when. Each document inside its own row, by arrays of its lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.operators.extraction import clean_value, place
from docloom.operators.extraction import lines as lines_of
from docloom.operators.sentences import collapse


def loose(*words: str) -> str:
    """A pattern of any of the words, with blanks between their characters."""
    return "(?:" + "|".join(r"\s*".join(map(_escaped, w)) for w in words) + ")"


def _escaped(x: str) -> str:
    return "\\" + x if x in r".^$*+?()[]{}|\\" else x


@dataclass(frozen=True)
class Account:
    """How an account of lines is told from what stands around it.

    It begins behind the ``label``. A line that is one of ``neighbours`` and nothing else is passed over. A ``heading`` anywhere in a line, or a line that is
    ``order`` and nothing else, ends the account once a line of substance has been read, of ``least`` characters and no heading; before, it is passed over.
    ``margin`` words at a line's beginning go. ``opening``: where in the joined account the telling begins.
    """

    label: str
    neighbours: tuple[str, ...] = ()
    order: str | None = None
    headings: tuple[str, ...] = ()
    margin: tuple[str, ...] = ()
    least: int = 6
    opening: str | None = None


#: The sections of a decision on an accident at sea, and the words around its account and its overview.
HEADINGS = ("판시요지", "판시사항", "원인판단", "관련법규", "재결요지", "해양사고관련자", "참고사항", "교훈", "이재결요약서는", "법적효력")
ACCIDENT = Account(label=loose("사고경위"), neighbours=("사건개요", "일시", "장소"), order="주문", headings=HEADINGS, margin=("주문", "사건개요"), opening=r"[가-힣0-9]+는\s+20\d{2}|ㅇ\s*[가-힣0-9]+호는")


def without_margin(c: Column, words: tuple[str, ...]) -> Column:
    """A cleaned line without labels that the margin put before it."""
    c = clean_value(c)
    for w in words:
        c = F.regexp_replace(c, rf"^{loose(w)}\s+", "")
    return clean_value(c)


def _read(c: Column, of: Account, first: bool) -> Column:
    """struct(said, told, ends) of a line: what it adds, whether that is of substance, whether the account may end here."""
    none = F.lit(False)
    alone = F.regexp_like(c, F.lit(f"^{loose(*of.neighbours)}$")) if of.neighbours else none
    order = F.regexp_like(c, F.lit(f"^{loose(of.order)}$")) if of.order and not first else none
    head = F.regexp_like(c, F.lit(loose(*of.headings))) if of.headings else none
    before = F.regexp_replace(c, f"(?s){loose(*of.headings)}.*$", "") if of.headings else c
    said = F.when(alone | order, "").when(head, clean_value(before) if first else without_margin(before, of.margin)).otherwise(without_margin(c, of.margin))
    bare = lambda x: F.regexp_like(x, F.lit(f"^{loose(*of.headings)}$")) if of.headings else none
    # inside a lambda, so that the line is cleaned once
    once = F.array(F.struct(said.alias("said"), (~alone & (order | head)).alias("ends")))
    return F.transform(once, lambda x: F.struct(x["said"].alias("said"), ((F.length(x["said"]) >= of.least) & ~bare(x["said"])).alias("told"), x["ends"].alias("ends")))[0]


def account(lines: Column, of: Account = ACCIDENT) -> Column:
    """The account in an array of lines, in one text; empty if no line has its label. Null or no lines: empty.

    Every line is read by itself; the account ends at the first line that may end it and doesn't come before the first of substance.
    """
    label = f"(?s)^.*?(?:{of.label})"
    begin = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(of.label))), F.lit(True)).cast("int")
    found = F.transform(F.filter(F.array(begin), lambda i: i > 0), lambda i: F.slice(lines, i, F.size(lines)))

    def read(rows: Column) -> Column:
        inline = _read(without_margin(F.regexp_replace(F.get(rows, F.lit(0)), label, ""), of.margin), of, True)
        return F.concat(F.array(inline), F.transform(F.slice(rows, 2, F.size(rows)), lambda x: _read(x, of, False)))

    def bounded(parts: Column) -> Column:
        told = F.array_position(F.transform(parts, lambda p: p["told"]), F.lit(True)).cast("int")
        return F.struct(parts.alias("parts"), told.alias("told"))

    def kept(s: Column) -> Column:
        end = F.array_position(F.transform(s["parts"], lambda p, i: p["ends"] & (s["told"] > 0) & (i + 1 >= s["told"])), F.lit(True)).cast("int")
        said = F.transform(F.when(end > 0, F.slice(s["parts"], 1, F.greatest(end, F.lit(1)))).otherwise(s["parts"]), lambda p: p["said"])
        return clean_value(F.array_join(F.filter(said, lambda x: x != ""), " | "))

    # one step after the other, each bound once, so no lambda works out a whole array again
    text = F.get(F.transform(F.transform(F.transform(found, read), bounded), kept), F.lit(0))
    if of.opening:
        text = F.when(F.regexp_like(text, F.lit(of.opening)), clean_value(F.regexp_replace(text, f"(?s)^.*?(?={of.opening})", ""))).otherwise(text)
    return F.coalesce(text, F.lit(""))


@dataclass(frozen=True)
class Summary:
    """Where an overview stands: ways to find it in order, each (what opens it, the word that closes it, what follows it). ``noise`` words inside go. As the last
    resort the ``block`` that a word opens, if it has ``least`` visible characters."""

    ways: tuple[tuple[str, str, tuple[str, ...]], ...]
    noise: tuple[str, ...] = ()
    lead: str | None = None
    block: str | None = None
    block_ends: tuple[str, ...] = ()
    least: int = 6


#: What opens, closes and follows an overview.
_FOLLOWS = (r"나\.", r"2\.", "관련법규", "원인판단")
OVERVIEW = Summary(
    ways=((r"판시요지\s*가\.", "", (r"나\.", r"2\.\s*관련법규", "관련법규", "원인판단")), (r"가\.", "사안", _FOLLOWS), (r"가\.", "사건", _FOLLOWS)),
    noise=("주문", *HEADINGS), lead="판시사항", block="관련선박", block_ends=("일시", "장소", "사고경위"),
)


def overview(c: Column, of: Summary = OVERVIEW) -> Column:
    """The overview in a text, by the first way that finds one; empty without any. A null text is empty."""
    whole = collapse(F.coalesce(c, F.lit("")))

    def cleaned(v: Column) -> Column:
        v = clean_value(v)
        v = F.regexp_replace(v, rf"^{loose(of.lead)}\s*", "") if of.lead else v
        return clean_value(F.regexp_replace(v, loose(*of.noise), " ") if of.noise else v)

    found = [F.nullif(cleaned(F.regexp_extract(whole, rf"{opens}\s*(.*?{closes})\s*(?:{'|'.join(follows)})", 1)), F.lit("")) for opens, closes, follows in of.ways]
    if of.block:
        block = clean_value(F.regexp_replace(F.regexp_extract(whole, f"{loose(of.block)}(.*)", 1), rf"□?\s*{loose(*of.block_ends)}.*$", "") if of.block_ends else F.regexp_extract(whole, f"{loose(of.block)}(.*)", 1))
        found.append(F.when(F.length(F.regexp_replace(block, r"\s+", "")) >= of.least, F.concat(F.lit(f"{of.block}: "), block)))
    return F.coalesce(*found, F.lit(""))


#: The label of a date, also as it is misread; how far apart its numbers may stand; the mark of the long form.
DATE_LABEL, DATE_GAPS, LONG_FORM = r"일\s*[시지]|I\s*시", (2, 2, 4, 2), "년"


def occurred(lines: Column) -> Column:
    """Date and time in an array of lines: from a line with the label and the next, else from all; empty where none is in range."""
    pattern = r"(20\d{2})" + "".join(rf"\D{{0,{n}}}(\d{{1,2}})" for n in DATE_GAPS)
    nexts = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string")))
    labelled = F.filter(F.zip_with(lines, nexts, lambda a, b: F.when(F.regexp_like(a, F.lit(DATE_LABEL)), F.concat_ws(" ", a, b))), lambda x: x.isNotNull())

    def written(x: Column) -> Column:
        y, mo, d, h, mi = (F.regexp_extract(x, pattern, i).try_cast("int") for i in range(1, 6))
        good = mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59)
        long = F.contains(F.regexp_extract(x, pattern, 0), F.lit(LONG_FORM))
        return F.when(good & long, F.format_string("%d년 %d월 %d일 %02d시 %02d분", y, mo, d, h, mi)).when(good, F.format_string("%d. %d. %d. %02d:%02d경", y, mo, d, h, mi))

    found = F.filter(F.transform(F.concat(labelled, F.array(F.array_join(lines, "\n"))), written), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def report(c: Column) -> Column:
    """struct(overview, occurred, place, account) of a report's text; an overview that says what the account says is left empty."""
    rows = F.transform(F.array(lines_of(c)), lambda x: F.struct(overview(c).alias("overview"), occurred(x).alias("occurred"), place(x).alias("place"), account(x).alias("account")))
    return F.transform(rows, lambda r: F.struct(F.when(collapse(r["overview"]) == collapse(r["account"]), "").otherwise(r["overview"]).alias("overview"), r["occurred"].alias("occurred"), r["place"].alias("place"), r["account"].alias("account")))[0]
