"""Replies against a schema and against what they may cite; attempts in turn until one is accepted."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from fractions import Fraction
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.passages import json_object

Check = Callable[[Any, list], list]
TYPES: dict[str, Callable[[Any], bool]] = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v == math.floor(v),
}
#: Keywords that say nothing about validity.
NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment", "format", "deprecated"}
#: Keywords that are read by another one: ``then`` and ``else`` by ``if``, ``additionalProperties`` by itself with its neighbours.
READ_ELSEWHERE = {"then", "else"}


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON: 1 and 1.0 are, 1 and true aren't."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _limit(kind: str, size: Callable[[Any], Any], bad: Callable[[Any, Any], bool], words: str) -> Callable[[Any, dict, dict], Check]:
    def make(limit: Any, schema: dict, root: dict) -> Check:
        return lambda v, at: [(at, f"{words} {limit}")] if TYPES[kind](v) and bad(size(v), limit) else []

    return make


def _type(names: Any, schema: dict, root: dict) -> Check:
    wanted = [names] if isinstance(names, str) else names
    return lambda v, at: [] if any(TYPES[n](v) for n in wanted) else [(at, f"is not of type {' or '.join(wanted)}")]


def _enum(values: list, schema: dict, root: dict) -> Check:
    return lambda v, at: [] if any(_same(v, x) for x in values) else [(at, f"is not one of {json.dumps(values, ensure_ascii=False)}")]


def _required(names: list, schema: dict, root: dict) -> Check:
    return lambda v, at: [(at, f"lacks {n}") for n in names if n not in v] if isinstance(v, dict) else []


def _properties(subs: dict, schema: dict, root: dict) -> Check:
    checks = {n: compile_schema(s, root) for n, s in subs.items()}
    return lambda v, at: [e for n, check in checks.items() if n in v for e in check(v[n], [*at, n])] if isinstance(v, dict) else []


def _patterns(subs: dict, schema: dict, root: dict) -> Check:
    checks = [(re.compile(p), compile_schema(s, root)) for p, s in subs.items()]
    return lambda v, at: [e for p, check in checks for n in v if p.search(n) for e in check(v[n], [*at, n])] if isinstance(v, dict) else []


def _additional(sub: Any, schema: dict, root: dict) -> Check:
    named, patterns = set(schema.get("properties", ())), [re.compile(p) for p in schema.get("patternProperties", ())]
    other = lambda v: [n for n in v if n not in named and not any(p.search(n) for p in patterns)]
    if sub is False:
        return lambda v, at: [(at, f"has the unknown {n}") for n in other(v)] if isinstance(v, dict) else []
    check = compile_schema(sub, root)
    return lambda v, at: [e for n in other(v) for e in check(v[n], [*at, n])] if isinstance(v, dict) else []


def _items(sub: Any, schema: dict, root: dict) -> Check:
    check, first = compile_schema(sub, root), len(schema.get("prefixItems", ()))
    return lambda v, at: [e for i, x in enumerate(v) if i >= first for e in check(x, [*at, i])] if isinstance(v, list) else []


def _prefix_items(subs: list, schema: dict, root: dict) -> Check:
    checks = [compile_schema(s, root) for s in subs]
    return lambda v, at: [e for i, (x, check) in enumerate(zip(v, checks)) for e in check(x, [*at, i])] if isinstance(v, list) else []


def _unique(wanted: bool, schema: dict, root: dict) -> Check:
    return lambda v, at: [(at, "has repeated items")] if wanted and isinstance(v, list) and any(_same(x, y) for i, x in enumerate(v) for y in v[:i]) else []


def _contains(sub: Any, schema: dict, root: dict) -> Check:
    check = compile_schema(sub, root)
    return lambda v, at: [] if not isinstance(v, list) or any(not check(x, at) for x in v) else [(at, "has no item of the kind it must contain")]


def _combined(name: str) -> Callable[[Any, dict, dict], Check]:
    def make(subs: list, schema: dict, root: dict) -> Check:
        checks = [compile_schema(s, root) for s in subs]
        if name == "allOf":
            return lambda v, at: [e for check in checks for e in check(v, at)]
        good = (lambda n: n >= 1) if name == "anyOf" else (lambda n: n == 1)
        return lambda v, at: [] if good(sum(not check(v, at) for check in checks)) else [(at, f"fits not {'any' if name == 'anyOf' else 'exactly one'} of the given schemas")]

    return make


def _not(sub: Any, schema: dict, root: dict) -> Check:
    check = compile_schema(sub, root)
    return lambda v, at: [] if check(v, at) else [(at, "fits a schema it must not fit")]


def _if(sub: Any, schema: dict, root: dict) -> Check:
    when, then, other = (compile_schema(s, root) for s in (sub, schema.get("then", True), schema.get("else", True)))
    return lambda v, at: other(v, at) if when(v, at) else then(v, at)


def _ref(where: str, schema: dict, root: dict) -> Check:
    if not where.startswith("#"):
        raise ValueError(f"only references inside the schema: {where}")
    target: Any = root
    for step in where[1:].strip("/").split("/") if len(where) > 1 else []:
        target = target[step.replace("~1", "/").replace("~0", "~")]
    made: list[Check] = []  # when first used, for a schema may refer to itself

    def check(v: Any, at: list) -> list:
        if not made:
            made.append(compile_schema(target, root))
        return made[0](v, at)

    return check


KEYWORDS: dict[str, Callable[[Any, dict, dict], Check]] = {
    "type": _type,
    "enum": _enum,
    "const": lambda value, schema, root: lambda v, at: [] if _same(v, value) else [(at, f"is not {json.dumps(value, ensure_ascii=False)}")],
    "required": _required,
    "properties": _properties,
    "patternProperties": _patterns,
    "additionalProperties": _additional,
    "items": _items,
    "prefixItems": _prefix_items,
    "uniqueItems": _unique,
    "contains": _contains,
    "allOf": _combined("allOf"),
    "anyOf": _combined("anyOf"),
    "oneOf": _combined("oneOf"),
    "not": _not,
    "if": _if,
    "$ref": _ref,
    "minLength": _limit("string", len, lambda n, m: n < m, "is shorter than"),
    "maxLength": _limit("string", len, lambda n, m: n > m, "is longer than"),
    "pattern": lambda p, schema, root: lambda v, at: [(at, f"doesn't match {p}")] if isinstance(v, str) and not re.search(p, v) else [],
    "minItems": _limit("array", len, lambda n, m: n < m, "has fewer items than"),
    "maxItems": _limit("array", len, lambda n, m: n > m, "has more items than"),
    "minProperties": _limit("object", len, lambda n, m: n < m, "has fewer members than"),
    "maxProperties": _limit("object", len, lambda n, m: n > m, "has more members than"),
    "minimum": _limit("number", lambda v: v, lambda n, m: n < m, "is less than"),
    "maximum": _limit("number", lambda v: v, lambda n, m: n > m, "is more than"),
    "exclusiveMinimum": _limit("number", lambda v: v, lambda n, m: n <= m, "is not more than"),
    "exclusiveMaximum": _limit("number", lambda v: v, lambda n, m: n >= m, "is not less than"),
    "multipleOf": _limit("number", lambda v: v, lambda n, m: not math.isfinite(n) or Fraction(str(n)) % Fraction(str(m)) != 0, "is not a multiple of"),
}


def compile_schema(schema: Any, root: dict | None = None) -> Check:
    """A function of (value, path) that lists (path, message). A keyword that isn't known is refused, so that nothing passes unchecked."""
    if schema is True:
        return lambda v, at: []
    if schema is False:
        return lambda v, at: [(at, "is not allowed")]
    root = schema if root is None else root
    if unknown := schema.keys() - KEYWORDS.keys() - NOTES - READ_ELSEWHERE:
        raise ValueError(f"unknown keywords of the schema: {sorted(unknown)}")
    checks = [KEYWORDS[k](v, schema, root) for k, v in schema.items() if k in KEYWORDS]
    return lambda v, at: [e for check in checks for e in check(v, at)]


def with_choices(schema: dict, path: list[str], choices: list) -> dict:
    """The schema with an enum at the path; the given one stays as it is."""
    out = json.loads(json.dumps(schema))
    at = out
    for step in path:
        at = at[step]
    at["enum"] = list(choices)
    return out


def schema_errors(c: Column, schema: dict) -> Column:
    """Array of ``path: message`` in order of paths; empty for a valid text, null for one that isn't JSON (nor has JSON from its first { to its last }),
    and for one with a number of over 4,300 digits or nested too deep to walk. No reply fails the job."""
    compile_schema(schema)  # fails here, not in a task

    @F.pandas_udf("array<string>")
    def errors(texts: pd.Series) -> pd.Series:
        check = compile_schema(schema)

        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            try:
                found = check(json.loads(t), [])
            except (ValueError, RecursionError):  # numbers of thousands of digits, very deep nesting
                return None
            return [f"{json.dumps(at, ensure_ascii=False)}: {m}" for at, m in sorted(found, key=lambda e: ([(isinstance(s, str), str(s) if isinstance(s, str) else s) for s in e[0]], e[1]))]

        return texts.map(one)

    return errors(json_object(c))


def _is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


#: Error codes, and the levels of support that need an id.
NO_NAME, FOREIGN_ID, UNSUPPORTED = "P02_EMPTY_CAUSE_NAME", "P02_HALLUCINATED_SOURCE_ID", "P02_UNSUPPORTED_HIGH_CONFIDENCE"
NO_CODE, UNKNOWN_CODE = "P03_EMPTY_LABEL_CODE", "P03_UNKNOWN_LABEL_CODE"
NEEDS_ID = ("HIGH", "MEDIUM")


def cause_errors(causes: Column, allowed: Column) -> Column:
    """Array of error codes, a code for each fault, of causes (cause_name, support_level, fact_ids, evidence_ids).

    A blank name; per list of ids, one that isn't allowed; a HIGH or MEDIUM support without any id. Null causes are none, null lists are empty.
    """
    ids = lambda x, n: F.coalesce(x[n], F.array().cast("array<string>"))
    cited = lambda x, n: F.when(F.size(F.array_except(ids(x, n), allowed)) > 0, FOREIGN_ID)
    bare = lambda x: F.size(ids(x, "fact_ids")) + F.size(ids(x, "evidence_ids")) == 0
    faults = lambda x: F.array(
        F.when(_is_blank(x["cause_name"]), NO_NAME), cited(x, "fact_ids"), cited(x, "evidence_ids"),
        F.when(x["support_level"].isin(*NEEDS_ID) & bare(x), UNSUPPORTED),
    )
    given = F.filter(causes, lambda x: x.isNotNull())
    return F.coalesce(F.array_compact(F.flatten(F.transform(given, faults))), F.array().cast("array<string>"))


def code_errors(codes: Column, known: Column) -> Column:
    """struct(errors, total, good, empty, unknown) of an array of label codes; a blank one is empty, one that isn't known unknown."""
    items = F.coalesce(codes, F.array().cast("array<string>"))
    fault = F.transform(items, lambda x: F.when(_is_blank(x), NO_CODE).when(~F.array_contains(known, x), UNKNOWN_CODE))

    def counted(f: Column) -> Column:
        bad = F.array_compact(f)
        empty = F.size(F.filter(bad, lambda x: x == NO_CODE))
        return F.struct(bad.alias("errors"), F.size(f).alias("total"), (F.size(f) - F.size(bad)).alias("good"), empty.alias("empty"), (F.size(bad) - empty).alias("unknown"))

    # inside a lambda, so that the faults are worked out once
    return F.get(F.transform(F.array(fault), counted), F.lit(0))


def escalate(df: DataFrame, key: str, attempts: list[Callable[[DataFrame], DataFrame]], accepted: Column, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(the attempts' columns, attempts_used, succeeded) of every row: each attempt takes only the rows that none before got accepted, and replaces their result.

    An attempt keeps ``key`` and the columns of df that a later one needs, and gives one row for each it takes. ``write`` stores a table under a name and reads it back, so that an attempt (a
    model's call, say) runs once. The list of attempts is bounded; no row is brought to the driver.
    """
    todo, done = df, None
    for k, attempt in enumerate(attempts, 1):
        tried = write(attempt(todo), f"attempt-{k}").withColumn("__good", F.coalesce(accepted, F.lit(False)))
        ended = (tried if k == len(attempts) else tried.where("__good")).select("*", F.lit(k).alias("attempts_used"), F.col("__good").alias("succeeded")).drop("__good")
        done = ended if done is None else done.unionByName(ended)
        todo = df.join(tried.where("NOT __good").select(key), key, "left_semi")
    if done is None:
        raise ValueError("no attempt")
    return done


#: The headings that a role's description must have, its least length, and what one of them must name.
HEADINGS = ("페르소나 ID", "역할 정의", "법령 기반", "입력 계약", "수행업무", "출력 계약", "원문 인용 규칙", "오류 및 반려 조건", "금지행동", "인간 전문가 검토조건", "품질검증 체크리스트", "실제 실행용 System Prompt", "실제 실행용 User Prompt Template")
LEAST_CHARS = 2500
NAMED = {"KMST-P03": ("official_ratio", "analytic_contribution_score", "GOLDSET_CANDIDATE")}
OUTSIDE, SAID = "OBD", ("제외", "배제")


def description_faults(text: Column, role: Column) -> Column:
    """Array of faults of a role's description: too short, without the role's id, a heading or a name it must have, or silent on what is outside."""
    lacks = lambda x: ~F.contains(text, F.lit(x))
    out = [F.when(F.length(text) < LEAST_CHARS, "short"), F.when(~F.contains(text, role), "role")]
    out += [F.when(lacks(h), f"heading: {h}") for h in HEADINGS]
    out += [F.when((role == r) & lacks(n), f"name: {n}") for r, names in NAMED.items() for n in names]
    out.append(F.when(F.contains(text, F.lit(OUTSIDE)) & lacks(SAID[0]) & lacks(SAID[1]), "outside"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*out)))


def variants(text: Column, start: str, end: str) -> Column:
    """struct(on, off, blocks): the text with and without its marked blocks, which must be paired; null where marks are missing or nested."""
    s, e = re.escape(start), re.escape(end)
    block = f"(?s){s}\\n?(.*?){e}\\n?"
    n = F.regexp_count(text, F.lit(s))
    on, off = F.regexp_replace(text, block, "$1"), F.regexp_replace(text, block, "")
    clean = (n > 0) & (n == F.regexp_count(text, F.lit(e))) & ~F.contains(on, F.lit(start)) & ~F.contains(on, F.lit(end))
    return F.when(clean, F.struct(on.alias("on"), off.alias("off"), n.alias("blocks")))
