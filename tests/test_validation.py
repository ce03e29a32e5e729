import pytest
from pyspark.sql import functions as F

from docloom.operators import validation as v


def errors(schema, value):
    return [m for _, m in v.compile_schema(schema)(value, [])]


@pytest.mark.parametrize(
    "schema,good,bad",
    [
        ({"type": "integer"}, [1, 2.0], [1.5, True, "1", None]),
        ({"type": ["number", "null"]}, [1.5, None], [False, "x"]),
        ({"enum": ["a", 1]}, ["a", 1, 1.0], [True, "b"]),
        ({"const": {"a": [1]}}, [{"a": [1.0]}], [{"a": [True]}, {}]),
        ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, ["ab", 5], ["a", "abcd", "ba"]),
        ({"minimum": 1, "exclusiveMaximum": 3, "multipleOf": 0.1}, [1, 2.3, "x"], [0.5, 3, 1.25]),
        ({"required": ["a"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}, [{"a": ""}, []], [{}, {"a": 1}, {"a": "", "b": 1}]),
        ({"patternProperties": {"^x": {"type": "null"}}, "additionalProperties": {"type": "boolean"}}, [{"x1": None, "y": True}], [{"x1": 1}, {"y": 1}]),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}, "minItems": 1, "uniqueItems": True}, [["a", 1, 2]], [[], [1], ["a", "b"], ["a", 1, 1.0]]),
        ({"contains": {"const": 1}}, [[0, 1], "x"], [[], [0]]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 6], [4]),
        ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 3], [6, 5]),
        ({"allOf": [{"minimum": 1}], "not": {"const": 2}}, [1], [0, 2]),
        ({"if": {"type": "string"}, "then": {"minLength": 1}, "else": {"type": "null"}}, ["a", None], ["", 1]),
        ({"$defs": {"t": {"properties": {"c": {"items": {"$ref": "#/$defs/t"}}}, "required": ["n"]}}, "$ref": "#/$defs/t"}, [{"n": 1, "c": [{"n": 2}]}], [{"n": 1, "c": [{}]}]),
        (True, [1], []),
        (False, [], [1]),
    ],
)
def test_keywords(schema, good, bad):
    assert all(not errors(schema, x) for x in good) and all(errors(schema, x) for x in bad)


def test_unknown_keywords_are_refused_and_choices_set():
    with pytest.raises(ValueError):
        v.compile_schema({"properties": {"a": {"minlength": 1}}})
    schema = {"properties": {"code": {"type": "string"}}}
    assert errors(v.with_choices(schema, ["properties", "code"], ["A"]), {"code": "B"}) and not errors(schema, {"code": "B"})


def test_errors_of_texts(spark):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 5}, "l": {"items": {"type": "string"}}}}
    cases = {'{"k": 1}': [], 'said {"k": 9, "l": ["a", 1, 2]} so': ['["k"]: is more than 5', '["l", 1]: is not of type string', '["l", 2]: is not of type string'], "{}": ["[]: lacks k"], "no": None, "": None, None: None}
    df = spark.createDataFrame([(c,) for c in cases], "c string").coalesce(1)
    assert [r[0] for r in df.select(v.schema_errors(F.col("c"), schema)).collect()] == list(cases.values())


def test_meanings(spark):
    kind = "a array<struct<cause_name:string,support_level:string,fact_ids:array<string>,evidence_ids:array<string>>>"
    rows = [[("x", "HIGH", ["S01"], None)], [("", "LOW", ["S09"], ["S08", "S01"]), ("y", "MEDIUM", [], None)], None, [], [None]]
    df = spark.createDataFrame([(r,) for r in rows], kind).coalesce(1)
    got = [r[0] for r in df.select(v.cause_errors(F.col("a"), F.array(F.lit("S01")))).collect()]
    assert got == [[], ["P02_EMPTY_CAUSE_NAME", "P02_HALLUCINATED_SOURCE_ID", "P02_HALLUCINATED_SOURCE_ID", "P02_UNSUPPORTED_HIGH_CONFIDENCE"], [], [], []]
    df = spark.createDataFrame([(["A", " ", None, "Z"],), (None,)], "a array<string>").coalesce(1)
    got = [r[0] for r in df.select(v.code_errors(F.col("a"), F.array(F.lit("A")))).collect()]
    assert [tuple(r) for r in got] == [(["P03_EMPTY_LABEL_CODE", "P03_EMPTY_LABEL_CODE", "P03_UNKNOWN_LABEL_CODE"], 4, 1, 2, 1), ([], 0, 0, 0, 0)]


def test_attempts(spark):
    df = spark.createDataFrame([(1, 5), (2, 15), (3, 25), (4, None)], "id int, n int")
    ran = []

    def attempt(most):
        def go(rows):
            ran.append(sorted(r.id for r in rows.collect()))
            return rows.select("id", F.when(F.col("n") < most, F.lit(f"<{most}")).otherwise(F.lit(f"not <{most}")).alias("reply"))

        return go

    out = v.escalate(df, "id", [attempt(10), attempt(20), attempt(22)], F.col("reply").startswith("<"), lambda d, name: d)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "<10", 1, True), (2, "<20", 2, True), (3, "not <22", 3, False), (4, "not <22", 3, False)]
    assert ran == [[1, 2, 3, 4], [2, 3, 4], [3, 4]]


def test_descriptions_and_variants(spark):
    full = " ".join(v.HEADINGS) + " KMST-P03 " + " ".join(v.NAMED["KMST-P03"]) + "." * 2500
    rows = [(full, "KMST-P03"), (full.replace("금지행동", "").replace("GOLDSET_CANDIDATE", "") + " OBD", "KMST-P03"), ("x", "R"), (None, "R")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, r string").coalesce(1).select(v.description_faults(F.col("t"), F.col("r"))).collect()]
    assert got[:2] == [[], ["heading: 금지행동", "name: GOLDSET_CANDIDATE", "outside"]] and got[2][:2] == ["short", "role"] and got[3] == ["empty"]
    rows = ["a\n[I]\nb\n[/I]\nc [I]d[/I]", "none", "[I] x", "[I] a [I] b [/I] c [/I]", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(v.variants(F.col("t"), "[I]", "[/I]")).collect()]
    assert tuple(got[0]) == ("a\nb\nc d", "a\nc ", 2) and got[1:] == [None] * 4
