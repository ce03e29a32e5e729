"""Conversation structure repair: the cheapest edits that give each conversation a right order of roles, by layers of cost.

A right conversation is ``(s?(ua)+)?`` in role initials: nothing, or an optional system turn and then user and assistant in turn. The
grammar has four states (start, after s, after u, after a); start and after a accept. Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (required
for blank and duplicate turns), Insert of an empty user or assistant turn 2; a truncated turn that stays costs 1 more.

Between any two turns stands one word of bits, four bits a layer: bit q of layer d says that from state q the rest of the conversation can be
accepted at cost d exactly. An edit of cost c moves the states back along its letter, for all layers at once by masks, and shifts
them by c layers. Layers are counted from the cheapest that is in use; any state costs at most 7 more than the cheapest state
(two inserts, a deletion), so 15 layers of a 64-bit integer lose nothing, however long a conversation is and however much its repair costs. The first
layer in which the start state is found at the front is the cost. The bits are then traced from the front: at each step the ASCII-least edit
whose layer holds the state it leads to, so the audit is the least of the cheapest ones.

Scale: one shuffle, by conversation. Words are made in a stream over turns in falling order and traced in a stream in rising
order; either holds one word and never a conversation, so a conversation of any number of turns takes constant memory. A single conversation is ordered
and read by one task, since its audit and digest are sequences by definition; the cost of that is in proportion to its turns. Many equal conversations are spread by id.

Defined results: null roles and texts are one space, a null turn stands before others, turns of one number stand by role, then text. A null id is one
conversation. The first fault of a turn counts: blank (no character but the six ASCII blanks), duplicate (role and text seen before in the
conversation), truncated (the last such character isn't ``.``, ``!`` or ``?``). A conversation without turns has an empty audit and costs nothing.
Texts of any length are read whole. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_key
from .resample import CRC_TABLE, crc_sql

BLANK = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The bit of state 0 in each of 15 layers, and all bits.
_EACH = sum(1 << 4 * d for d in range(15))
_ALL = 15 * _EACH
#: The states from which a letter leads on, and where to.
_FROM = {"s": (1 << START, AFTER_S), "u": (1 << START | 1 << AFTER_S | 1 << AFTER_A, AFTER_U), "a": (1 << AFTER_U, AFTER_A)}
#: The one new turn that each state takes, and its role.
_NEW = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
_ROLE = {"u": "user", "a": "assistant"}
_TURN = "conv string, seq long, turn string, fresh boolean, present boolean, fault string, role string, text string"


def _back(word: int, letter: str) -> int:
    """The states from which the letter leads to a state of the word, layer by layer."""
    states, to = _FROM[letter]
    return (word >> to & _EACH) * states


def _new(word: int) -> int:
    return _back(word, "u") | _back(word, "a")


def _closed(word: int, base: int) -> tuple[int, int]:
    """The word with inserts before it, counted from its cheapest layer. More than two inserts in a row come back to the same state."""
    for _ in range(2):
        word |= _new(word) << 4 * INSERT
    while not word & 15:
        word, base = word >> 4, base + 1
    return word & _ALL, base


_END = _closed(1 << START | 1 << AFTER_A, 0)


def _before(word: int, base: int, initial: str, fault: str | None) -> tuple[int, int]:
    """The word before a turn, from the word after it."""
    out = word << 4 * DELETE
    if fault not in ("blank", "duplicate"):
        more = 4 * TRUNCATED * (fault == "truncated")
        out |= _new(word) << 4 * REROLE + more
        if initial in _FROM:
            out |= _back(word, initial) << more
    return _closed(out, base)


def _holds(word: int, base: int, state: int, cost: int) -> bool:
    return 0 <= cost - base < 15 and bool(word >> 4 * (cost - base) + state & 1)


def _layers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns in falling order, with the word after each."""
    at, (word, base) = object(), _END
    for part in parts:
        words, bases = [], []
        for conv, present, fault, role in zip(part["conv"], part["present"], part["fault"], part["role"], strict=True):
            if conv != at:
                at, (word, base) = conv, _END
            words.append(word)
            bases.append(base)
            if present:
                word, base = _before(word, base, role[:1], fault)
        yield part.assign(word=words, base=bases)


def _edit(state: int, cost: int, role: str, fault: str | None, after: tuple[int, int], before: tuple[int, int]) -> tuple[str, int, int]:
    """The ASCII-least edit on a cheapest way, and the state and cost that are left. A null role: no turn is left."""
    letter, more = _NEW[state], TRUNCATED * (fault == "truncated")
    if role is not None and _holds(*after, state, cost - DELETE):
        return "D", state, cost - DELETE
    if _holds(*before, _FROM[letter][1], cost - INSERT):
        return "I", _FROM[letter][1], cost - INSERT
    states, to = _FROM.get(role[:1], (0, 0))
    if fault not in ("blank", "duplicate") and states >> state & 1 and _holds(*after, to, cost - more):
        return "K", to, cost - more
    return "R", _FROM[letter][1], cost - REROLE - more


def _traced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns in rising order, new ones among them, with the edit of each; ``was`` is the role before, null for new ones.

    A row without an edit names a conversation only.
    """
    at, state, cost, seq, some, rows = None, START, None, 0, False, []

    def ended() -> Iterator[tuple]:
        """New turns at the end of the conversation that was read."""
        nonlocal state, cost
        while cost:
            edit, new_state, cost = _edit(state, cost, None, None, _END, _END)
            yield at, seq, None, False, None, None, edit, _ROLE[_NEW[state]], ""
            state = new_state

    for part in parts:
        for conv, seq_, turn, fresh, present, fault, role, text, word, base in part.itertuples(index=False, name=None):
            if not some or conv != at:
                rows += ended()
                at, state, cost, some = conv, START, None, True
            seq = seq_
            if not present:
                rows.append((conv, seq, None, False, None, None, None, None, None))
                continue
            before = _before(word, base, role[:1], fault)
            if cost is None:
                cost = next(d for d in range(before[1], before[1] + 15) if _holds(*before, START, d))
            edit = ""
            while edit in ("", "I"):
                new = _ROLE[_NEW[state]]
                edit, state, cost = _edit(state, cost, role, fault, (word, base), before)
                if edit == "I":
                    rows.append((conv, seq, None, False, None, None, "I", new, ""))
            rows.append((conv, seq, turn, fresh, fault, role, edit, *{"D": (None, None), "K": (role, text), "R": (new, text)}[edit]))
        yield pd.DataFrame(rows, columns=_EDITED)
        rows.clear()
    yield pd.DataFrame([*ended()], columns=_EDITED)


_EDITED = ["conv", "seq", "turn", "fresh", "fault", "was", "edit", "role", "text"]
_SUMS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each conversation, from edited turns in order."""
    counts, at, some, out = {}, None, False, []

    def ended() -> list[tuple]:
        c = counts
        gaps = c["last"] - c["first"] + 1 - c["turns"] if c["turns"] else 0
        return [(at, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], "".join(c["audit"]), c["digest"].hexdigest())]

    for part in parts:
        for conv, _, turn, fresh, fault, was, edit, role, text in part.itertuples(index=False, name=None):
            if not some or conv != at:
                out += ended() if some else []
                at, some = conv, True
                counts = dict.fromkeys(("turns", "first", "last", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": [], "digest": hashlib.sha256(), "was": None, "kept": False}
            if edit is None:
                continue
            counts["audit"].append(edit)
            counts["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (edit in "KR" and fault == "truncated")
            if edit != "I":
                if counts["was"] is not None and counts["was"][:1] + was[:1] not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                counts["was"] = was
                if fault is not None:
                    counts[fault] += 1
                if fresh:
                    counts |= {"first": counts["first"] if counts["turns"] else int(turn), "last": int(turn), "turns": counts["turns"] + 1}
            if edit != "D":
                counts["digest"].update(f"{'\n' if counts['kept'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                counts["kept"] = True
        yield pd.DataFrame(out, columns=_SUMS)
        out = []
    yield pd.DataFrame(ended() if some else [], columns=_SUMS)


def _last_character(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(BLANK)), -1, 1)


def _edited(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    """Edited turns, each conversation in one partition and in order."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
        (F.col(present_col) if present_col else F.lit(True)).alias("present"),
    ).repartition("conv")
    # both windows are finer than the partitioning, so nothing is shuffled again
    same = Window.partitionBy("conv", "present", "role", text_key(F.col("text"))).orderBy(F.col("t").asc_nulls_first())
    order = Window.partitionBy("conv", "present").orderBy(F.col("t").asc_nulls_first(), "role", "text", "copy")
    last = _last_character(F.col("text"))
    fault = F.when(last == "", "blank").when(F.col("copy") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    fresh = F.col("t").isNotNull() & ~F.col("t").eqNullSafe(F.lag("t").over(order))
    placed = rows.withColumn("copy", F.row_number().over(same)).withColumn("seq", F.row_number().over(order).cast("long")).withColumn("fresh", fresh)
    turn_rows = placed.select("conv", "seq", F.col("t").cast("string").alias("turn"), "fresh", "present", fault.alias("fault"), "role", "text")
    layered = turn_rows.sortWithinPartitions("conv", "present", F.desc("seq")).mapInPandas(_layers, _TURN + ", word long, base long")
    return layered.sortWithinPartitions("conv", "present", "seq").mapInPandas(_traced, "conv string, seq long, turn string, fresh boolean, fault string, was string, edit string, role string, text string")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn with its fault and edit, and the new turns: (conv, at, turn, fault, was, edit, role, text). A deleted turn has no new role and text.

    ``at`` is gapless from 1 in a conversation.
    """
    edited = _edited(turns, conv_col, turn_col, role_col, text_col, None)
    at = F.row_number().over(Window.partitionBy("conv").orderBy("seq", F.when(F.col("edit") == "I", 0).otherwise(1)))
    kind = dict(turns.dtypes)
    return edited.where(F.col("edit").isNotNull()).select(F.col("conv").cast(kind[conv_col]).alias("conv"), at.alias("at"), F.col("turn").cast(kind[turn_col]).alias("turn"), "fault", "was", "edit", "role", "text")


def report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """A row for each conversation: its faults, the cost and audit of its repair, and a digest of what is repaired.

    Rows for which present_col is false name a conversation and are no turns.
    """
    sums = _edited(turns, conv_col, turn_col, role_col, text_col, present_col).mapInPandas(_summed, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return sums.withColumn("conv", F.col("conv").cast(dict(turns.dtypes)[conv_col])).withColumnRenamed("conv", conv_col)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): conversations with faults set by a checksum of id and turn. Dropped turns stay as rows that aren't present."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    code = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code.alias("code"))
    text = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    changed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") != 0).alias("present"), "code")
    return changed.withColumn("x", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("x", "code")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damage(table(spark, sf_dir, "conversations")), present_col="present")


#: The same by a recursion over turns that keeps the least (cost, audit) of each state.
OP12_SQL = f"""
with recursive {CRC_TABLE},
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code from conversations, crc),
damaged as (
  select conv_id, turn, case code when 4 then 'user' else role end as role, case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case code when 0 then [] when 3 then [1, 2] else [1] end) as copy from named)),
numbered as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as copy from damaged),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, lag(role) over (partition by conv_id order by turn nulls first, role, text, copy) as previous, left(role, 1) as r,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when copy > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault
  from numbered),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (previous is not null and left(previous, 1) || r not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from placed group by conv_id),
letters(q, l, p) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, p, cost, audit, new) as (
  select q, q, 0, '', []::varchar[] from range(4) x(q) union all values (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (3, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:'])),
edits as (
  select conv_id, i, q, p, cost + (l is not null and fault = 'truncated')::int as cost, audit, new from (
    select conv_id, i, q, q as p, 3 as cost, 'D' as audit, []::varchar[] as new, null::varchar as l, fault from placed, range(4) x(q)
    union all select conv_id, i, q, p, 0, 'K', [role || ':' || text], l, fault from placed join letters on l = r where fault not in ('blank', 'duplicate')
    union all select conv_id, i, q, p, 2, 'R', [case l when 'u' then 'user:' else 'assistant:' end || text], l, fault from placed, letters where l <> 's' and fault not in ('blank', 'duplicate'))),
steps as (
  select e.conv_id, e.i, a.q, e.p, min({{'cost': a.cost + e.cost, 'audit': a.audit || e.audit, 'new': a.new || e.new}}) as step
  from edits e join inserts a on a.p = e.q group by e.conv_id, e.i, a.q, e.p),
ways as (
  select conv_id, 0::bigint as i, 0 as q, {{'cost': 0, 'audit': '', 'new': []::varchar[]}} as way from sums
  union all
  select w.conv_id, s.i, s.p, min({{'cost': w.way.cost + s.step.cost, 'audit': w.way.audit || s.step.audit, 'new': w.way.new || s.step.new}})
  from ways w join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1 and s.q = w.q group by w.conv_id, s.i, s.p),
best as (
  select ways.conv_id, min({{'cost': way.cost + a.cost, 'audit': way.audit || a.audit, 'new': way.new || a.new}}) as way
  from ways join sums on sums.conv_id is not distinct from ways.conv_id join inserts a on a.q = ways.q where i = n and a.p in (0, 3) group by ways.conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(way.cost, 0)::bigint as cost, coalesce(way.audit, '') as audit, sha256(coalesce(array_to_string(way.new, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join sums on sums.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id
"""
