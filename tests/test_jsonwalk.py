import json
import random
import re

from pyspark.sql import functions as F

from docloom.operators import jsonwalk, validation
from docloom.operators.passages import json_object
from docloom.sources import containers

TEXTS = ["", " ", "plain", "In this representative event pattern", "배가 in 갔다 더 멀리 그리고 더", "A B C D E F G H", "ONE_SINGLE_TOKEN_OF_LATIN"]


def made(r, depth):
    kind = r.randrange(8) if depth else r.randrange(3, 8)
    if kind == 0:
        return [made(r, depth - 1) for _ in range(r.randrange(4))]
    if kind <= 2:
        return {k: made(r, depth - 1) for k in sorted(r.sample(["a_id", "b", "c", "d_id", "e"], r.randrange(5)))}
    return r.choice([None, True, 3, 2.5, *TEXTS])


def by_hand(v, path="$", parent=None, key=None, member=False, depth=0):
    yield path, parent, key, member, depth, v
    if isinstance(v, dict):
        for k in sorted(v):
            yield from by_hand(v[k], f"{path}.{k}", path, k, True, depth + 1)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from by_hand(x, f"{path}[{i}]", path, key, False, depth + 1)


def filled(v):
    return v.strip() != "" if isinstance(v, str) else bool(v) if isinstance(v, (dict, list)) else False


def test_walk_and_what_it_finds(spark):
    r = random.Random(5)
    values = [made(r, 4) for _ in range(150)]
    texts = [json.dumps(v, ensure_ascii=False) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", jsonwalk.walk(F.col("c")).alias("n"))
    x = F.transform("n", lambda n: F.struct(n["path"], n["parent"], n["key"], n["member"], n["depth"], F.to_json(n["value"])))
    got = {r.i: r for r in df.select("i", x.alias("nodes"), jsonwalk.empty_ids(F.col("n")).alias("empty"), jsonwalk.drifted(F.col("n")).alias("drift")).collect()}
    for i, v in enumerate(values):
        want = sorted(by_hand(v), key=lambda n: n[4])
        assert [tuple(n)[:5] for n in got[i].nodes] == [n[:5] for n in want]
        assert [json.loads(n[5]) for n in got[i].nodes] == [n[5] for n in want]
        content = {n[1] for n in want if n[3] and not n[2].endswith("_id") and filled(n[5])}
        assert got[i].empty == [n[0] for n in want if n[3] and n[2].endswith("_id") and isinstance(n[5], str) and not n[5].strip() and n[1] in content]
        drift = [n for n in want if isinstance(n[5], str) and " " in n[5].strip() and len(re.findall(r"\S", n[5])) >= 15 and len(re.findall("[A-Za-z]", n[5])) / len(re.findall(r"\S", n[5])) >= 0.6]
        assert got[i].drift == (f"{drift[0][2]}='{drift[0][5][:40]}...'" if drift else None)


def test_odd_texts(spark):
    deep = "[" * 300 + "1" + "]" * 300
    rows = [(0, deep), (1, None), (2, ""), (3, "{'a': 1}"), (4, '{"a":1,"a":2}'), (5, "7"), (6, "[" + ",".join(["1"] * 20_000) + "]")]
    got = dict(spark.createDataFrame(rows, "i int, c string").select("i", F.size(jsonwalk.walk(F.col("c")))).collect())
    assert got[0] == 301 and got[5] == 1 and got[6] == 20_001 and all(got[i] in (None, -1) for i in (1, 2, 3, 4))


def test_a_reply_is_whole_or_none(spark):
    cases = {'{"k":"x"} trailing {"j":1}': None, "{'k': 1}": None, '"abc"': '"abc"', "1,2": None, '1],[2': None, '1},{"y":2': None, 'so {"k": [1]} then': '{"k": [1]}', "": None, None: None, "[1] [2]": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string").coalesce(1)
    assert [r[0] for r in df.select(json_object(F.col("c"))).collect()] == list(cases.values())
    schema = {"type": "object", "properties": {"k": {"type": "integer", "multipleOf": 1e300}}}
    texts = ['"abc"', '{"k": 3}', '{"k": 1e300}', '{"k": 1e400}', '{"k": ' + "9" * 5000 + "}", "[" * 5000 + "]" * 5000, None]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").coalesce(1).select(validation.schema_errors(F.col("c"), schema)).collect()]
    assert out[0] == ["[]: is not of type object"] and out[1] == ['["k"]: is not a multiple of 1e+300'] and out[2] == [] and len(out[3] or [1]) > 0 and out[4] is None and out[6] is None


def test_marks_inside_runs():
    import io
    import zipfile

    body = "<s><p><run><t>alpha<lineBreak/>beta<tab/>gamma<x>in</x>d</t></run><lineBreak/><run><t>e</t></run></p></s>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section0.xml", body)
    assert [p["text"] for p in containers.decode_hwpx(out.getvalue())["paragraphs"]] == ["alpha\nbeta\tgammaind\ne"]
