"""Labelled fields of documents: where a label begins, what follows it, where its section ends. All inside a document's own row."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.operators.sentences import BLANKS, collapse, normalize_whole, sentences

#: Labels are compared by these characters alone; whatever stands between them doesn't count, but parts words.
UNIT = "0-9A-Za-z가-힣"


@dataclass(frozen=True)
class Rule:
    """A field: its label's spellings in order, the first letter by which a garbled label is still known, and whether a verdict ends it."""

    label: str
    aliases: tuple[str, ...]
    garbled: str | None = None
    digits: bool = False
    restart: bool = True
    fallback: Rule | None = None


@dataclass(frozen=True)
class Layout:
    """The fields of a kind of document and the further headings that end one. A ``party`` heading ends one only if at most ``tail`` characters follow."""

    rules: tuple[Rule, ...]
    headings: tuple[str, ...] = ()
    party: str | None = None
    tail: int = 6
    most: int = 12
    lead: str = "이 "
    verdicts: tuple[str, ...] = ()
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", tuple(dict.fromkeys([a for r in self.rules for a in r.aliases] + list(self.headings))))


#: The fields of a decision on an accident at sea, and the headings of its other sections.
DECISION = Layout(
    rules=(
        Rule("사건 개요", ("사건개요", "사건 개요")),
        Rule("일시", ("일시", "사고일시"), garbled="일", digits=True),
        Rule("장소", ("장소", "사고장소"), garbled="장"),
        Rule("사고 경위", ("사고경위", "사고 경위"), fallback=Rule("사고 경위", ("사고발생원인", "사고발생 원인"), restart=False)),
    ),
    headings=("판시요지", "판시 사항", "판시사항", "원인판단", "원인 판단", "주문", "주 문", "이유", "이 유", "관련법규", "참고사항", "참 고 사 항", "교훈", "교 훈", "재결요지", "이 재결요약서는", "법적 효력"),
    party="해양사고관련자",
    verdicts=("사건은", "사고는"),
)


def spaced(label: str) -> str:
    """A pattern of the label's letters and digits with anything else between them."""
    return f"[^{UNIT}]*".join(re.escape(x) for x in re.findall(f"[{UNIT}]", label))


def after(c: Column, label: str) -> Column:
    """What follows the first mention of the label as a word of its own; null without one."""
    whole = f"(?si)^.*?(?<![{UNIT}]){spaced(label)}(?![{UNIT}])"
    return F.when(F.regexp_like(c, F.lit(whole)), F.regexp_replace(c, whole, ""))


def _bytes(c: Column) -> Column:
    """A character per UTF-8 byte, so that patterns can count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _text(c: Column) -> Column:
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


def _pattern(s: str) -> str:
    return "".join(f"\\x{{{b:02X}}}" for b in s.encode())


#: A Hangul syllable by its bytes.
_HANGUL = r"(?:\x{EA}[\x{B0}-\x{BF}].|[\x{EB}\x{EC}]..|\x{ED}[\x{80}-\x{9D}].|\x{ED}\x{9E}[\x{80}-\x{A3}])"


def after_garbled(c: Column, letter: str, window: int = 15) -> Column:
    """What follows a colon within ``window`` bytes of a word that begins with the letter, without Hangul before the colon or next; else null."""
    near = f"(?:(?!{_HANGUL})[^:]){{0,{window - 1}}}:"
    whole = f"(?s)^.*?(?<![0-9A-Za-z]|{_HANGUL}){_pattern(letter)}(?!(?:(?!{_HANGUL})[^0-9A-Za-z])*{_HANGUL}){near}"
    return F.when(F.regexp_like(_bytes(c), F.lit(whole)), _text(F.regexp_replace(_bytes(c), whole, "")))


def begins_section(c: Column, layout: Layout) -> Column:
    """The text begins with one of the layout's labels or headings."""
    known = [spaced(x) for x in layout.names]
    if layout.party:
        known.append(f"{spaced(layout.party)}(?:[^{UNIT}]*[{UNIT}]){{0,{layout.tail}}}[^{UNIT}]*$")
    return F.regexp_like(c, F.lit(f"(?si)^[^{UNIT}]*(?:{'|'.join(known)})"))


def before_verdict(c: Column, layout: Layout, window: int = 60) -> Column:
    """What precedes the first ``lead`` from which a verdict follows within so many bytes and without a full stop; null if there is none."""
    if not layout.verdicts:
        return F.lit(None).cast("string")
    lead = _pattern(layout.lead)
    between = f"(?:(?!{lead})[^.]){{0,{window - len(layout.lead.encode())}}}"
    whole = f"(?s){lead}{between}(?:{'|'.join(_pattern(v) for v in layout.verdicts)}).*$"
    return F.when(F.regexp_like(_bytes(c), F.lit(whole)), _text(F.regexp_replace(_bytes(c), whole, "")))


def upto_section(c: Column, layout: Layout, restart: bool) -> Column:
    """struct(kept, stops): the part of a sentence before the next section, and whether one begins in it."""
    verdict = before_verdict(c, layout) if restart else F.lit(None).cast("string")
    opened = begins_section(c, layout)
    kept = F.when(opened, "").when(verdict.isNotNull(), collapse(verdict)).otherwise(c)
    return F.struct(kept.alias("kept"), (opened | verdict.isNotNull()).alias("stops"))


def meaningful(c: Column, digits: bool = False) -> Column:
    """At least two characters with Hangul, or, for dates, with six digits."""
    by_digits = F.length(F.regexp_replace(c, "[^0-9]+", "")) >= 6 if digits else F.lit(False)
    return (F.length(c) >= 2) & (F.regexp_like(c, F.lit("[가-힣]")) | by_digits)


def mentions(c: Column, rule: Rule) -> Column:
    """The text has one of the rule's labels as a word of its own: a single search, where ``after`` needs one a spelling."""
    found = F.regexp_like(c, F.lit(f"(?i)(?<![{UNIT}])(?:{'|'.join(map(spaced, rule.aliases))})(?![{UNIT}])"))
    return found | after_garbled(c, rule.garbled).isNotNull() if rule.garbled else found


def _follows(c: Column, rule: Rule) -> Column:
    found = [after(c, a) for a in rule.aliases] + ([after_garbled(c, rule.garbled)] if rule.garbled else [])
    return F.coalesce(*found)


def collect(parts: Column, rule: Rule, layout: Layout, useful=meaningful) -> Column:
    """The field's sentences: what follows its first label, then sentences until the next section, ``most`` of them; repeats go.

    ``parts``: a document's sentences in order. No label: an empty array, or what the rule's fallback finds.
    """
    def of_first(state: Column) -> Column:
        tail = F.regexp_replace(collapse(state["tail"]), r"^[\s:,\-]+", "")
        inline = upto_section(tail, layout, rule.restart)
        rest = F.transform(state["rest"], lambda x: upto_section(x, layout, rule.restart))
        return F.struct(inline.alias("inline"), rest.alias("rest"))

    def chunks(s: Column) -> Column:
        stop = F.array_position(F.transform(s["rest"], lambda x: x["stops"]), F.lit(True)).cast("int")
        used = F.when(s["inline"]["stops"], F.slice(s["rest"], 1, 0)).when(stop > 0, F.slice(s["rest"], 1, F.greatest(stop, F.lit(1)))).otherwise(s["rest"])
        every = F.concat(F.array(s["inline"]["kept"]), F.transform(used, lambda x: x["kept"]))
        return F.array_distinct(F.slice(F.filter(every, lambda x: useful(x, rule.digits)), 1, layout.most))

    first = F.array_position(F.transform(parts, lambda x: mentions(x, rule)), F.lit(True)).cast("int")
    state = F.transform(F.filter(F.array(first), lambda i: i > 0), lambda i: F.struct(_follows(F.get(parts, i - 1), rule).alias("tail"), F.slice(parts, i + 1, F.size(parts)).alias("rest")))
    found = F.coalesce(F.get(F.transform(F.transform(state, of_first), chunks), F.lit(0)), F.array().cast("array<string>"))
    if rule.fallback is None:
        return found
    # inside a lambda, so that what is found is worked out once
    other = collect(parts, rule.fallback, layout, useful)
    return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(other)), F.lit(0))


def document_sentences(paragraphs: Column, normalize=normalize_whole) -> Column:
    """The sentences of an array of paragraphs in order; each paragraph is normalised first and blank ones go."""
    kept = F.filter(F.transform(F.filter(paragraphs, lambda x: x.isNotNull()), normalize), lambda x: x != "")
    return F.flatten(F.transform(kept, sentences))


def fields(paragraphs: Column, layout: Layout = DECISION) -> Column:
    """Array of (label, sentences) of every field in the layout's order. Null paragraphs count as none."""
    parts = document_sentences(F.coalesce(paragraphs, F.array().cast("array<string>")))
    return F.array(*[F.struct(F.lit(r.label).alias("label"), collect(parts, r, layout).alias("sentences")) for r in layout.rules])


def lines(c: Column) -> Column:
    """The text's lines, blanks collapsed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " "))), lambda x: x != "")


#: Bullets and enumerators that may stand before a value.
BULLETS = r"^[\s:：ㆍ·|□\[\]\-ㅇ○]+"
ENUMERATOR = r"^[가-하]\.\s*"


def clean_value(c: Column) -> Column:
    """A value without bullets and an enumerator before it."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), BULLETS, ""), ENUMERATOR, ""))


#: A position is six numbers, north then east; the signs that may follow each, misread ones among them, and what may join both halves.
NORTH, EAST, SEA = "북위", "동경", "해상"
SIGNS = (("도", "m"), ("분", "4", "%"), ("초", "%"), ("도", "m"), ("분", "2", "%"), ("초", "%"))
JOINS = ("동경", "-", "·", "ㆍ")
#: What a line with a place may show, its label as it is read, and the next section.
PLACE_SHOWS, PLACE_LABEL, PLACE_ENDS = r"장 ?소|북위|4\s*A", r"장\s*[소A]\s*[:：]?", r"사고 ?경위"
#: Labels of other fields that the layout mixes into a place.
PLACE_NOISE = r"사\s*건\s*개\s*요|사\s*고\s*경\s*위"


def _position_pattern() -> str:
    half = [rf"([0-9]{{1,3}})\s*(?:{'|'.join(signs)})?" for signs in SIGNS]
    return rf"{NORTH}\s*" + r"\s*".join(half[:3]) + rf"(?:\s*(?:{'|'.join(JOINS)}))+\s*" + r"\s*".join(half[3:]) + rf"(?:\s*\(\s*([^)]*{SEA})\s*\))?"


def position(c: Column) -> Column:
    """struct(numbers, sea): the six numbers of the first position in a text, as written, and the sea named in brackets behind; null without one."""
    found = F.regexp_extract(c, _position_pattern(), 0)
    read = F.transform(F.array(found), lambda x: F.array(*[F.regexp_extract(x, _position_pattern(), i) for i in range(1, 8)]))[0]
    return F.transform(F.array(read), lambda g: F.when(F.get(g, F.lit(0)) != "", F.struct(F.slice(g, 1, 6).alias("numbers"), F.get(g, F.lit(6)).alias("sea"))))[0]


def canonical_place(c: Column) -> Column:
    """A place in one form: its position and sea, or, without a position, what it says without other fields' labels."""

    def written(p: Column) -> Column:
        n = [F.get(p["numbers"], F.lit(i)) for i in range(6)]
        at = F.format_string(f"{NORTH} %s도 %s분 %s초 {EAST} %s도 %s분 %s초", *n)
        return F.when(p["sea"] != "", F.concat(at, F.lit(" ("), p["sea"], F.lit(")"))).otherwise(at)

    said = clean_value(F.regexp_replace(clean_value(c), PLACE_NOISE, " "))
    return F.coalesce(F.get(F.transform(F.filter(F.array(position(c)), lambda p: p.isNotNull()), written), F.lit(0)), said)


def place(text_lines: Column, most: int = 6) -> Column:
    """The first place that is a position or a sea, from a line that shows one and those after it; empty if there is none."""

    def read(i: Column) -> Column:
        near = F.array_join(F.slice(text_lines, i + 1, most), "\n")
        own = F.regexp_replace(F.regexp_replace(near, rf"(?s)(^|\n)[^\n]*(?:{PLACE_ENDS}).*$", ""), rf"(?s)({SEA}[^\n]*).*$", "$1")
        return canonical_place(F.regexp_replace(F.translate(own, "\n", " "), f".*{PLACE_LABEL}", ""))

    starts = F.filter(F.transform(text_lines, lambda x, i: F.when(F.regexp_like(x, F.lit(PLACE_SHOWS)), i)), lambda i: i.isNotNull())
    found = F.filter(F.transform(starts, read), lambda v: F.contains(v, F.lit(NORTH)) | F.contains(v, F.lit(SEA)))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def position_suspect(c: Column) -> Column:
    """A minute or second of the position is over 59. Without a position: false."""
    sexagesimal = lambda p: F.exists(F.array(*[F.get(p["numbers"], F.lit(i)).try_cast("int") for i in (1, 2, 4, 5)]), lambda n: n > 59)
    return F.coalesce(F.get(F.transform(F.filter(F.array(position(c)), lambda p: p.isNotNull()), sexagesimal), F.lit(0)), F.lit(False))


#: How far a field is trusted by where it comes from; any other origin, and a suspect place.
TRUST = {"native": 1.0, "paddle": 0.75, "ocrmypdf": 0.65}
OTHER, SUSPECT = 0.5, 0.4


def confidence(value: Column, origin: Column, suspect: Column | None = None, trust: dict[str, float] = TRUST) -> Column:
    """0 for a blank value, else the trust in its origin, at most SUSPECT where it is suspect."""
    known = F.coalesce(*[F.when(origin == o, t) for o, t in trust.items()], F.lit(OTHER))
    at_most = F.when(F.coalesce(suspect, F.lit(False)), F.least(known, F.lit(SUSPECT))).otherwise(known) if suspect is not None else known
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", 0.0).otherwise(at_most)


def tiered(tiers: dict[str, Column], enough: dict[str, Column] | None = None) -> Column:
    """struct(value, origin, tried): the first tier whose value is enough, else the last that has one.

    A later tier is adopted where it has a value, so every attempt replaces what came before; it is worked out only where none before was enough. ``enough``: per tier, by default a
    value that isn't blank.
    """
    names = list(tiers)
    filled = {n: F.coalesce(F.trim(tiers[n]), F.lit("")) != "" for n in names}
    good = {n: F.coalesce((enough or filled)[n], F.lit(False)) for n in names}
    row = lambda n, tried: F.struct(tiers[n].alias("value"), F.lit(n).alias("origin"), F.lit(tried).alias("tried"))
    out = None
    for k, n in enumerate(names, 1):
        out = F.when(good[n], row(n, k)) if out is None else out.when(good[n], row(n, k))
    for n in reversed(names):
        out = out.when(filled[n], row(n, len(names)))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("origin"), F.lit(len(names)).alias("tried")))
