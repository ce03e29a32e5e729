import random
import re

from pyspark.sql import functions as F

from docloom.operators import extraction
from docloom.operators import narrative as x

A = x.ACCIDENT


def run(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").coalesce(1).select(f(F.col("c"))).collect()]


def by_hand(lines, of):
    """Reads on from the label, line by line, and stops for good at the first place where the account may end."""
    said, told, begun = [], False, False

    def clean(s):
        return re.sub(r"^[가-하]\.\s*", "", re.sub(r"^[\s:：ㆍ·|□\[\]\-ㅇ○]+", "", " ".join(s.split()))).strip()

    def margin(s):
        s = clean(s)
        for w in of.margin:
            s = re.sub(rf"^{x.loose(w)}\s+", "", s)
        return clean(s)

    for line in lines:
        first = not begun
        if first:
            if not re.search(of.label, line):
                continue
            begun, line = True, margin(re.split(of.label, line, maxsplit=1)[1])
        if re.fullmatch(x.loose(*of.neighbours), line):
            continue
        lone = not first and re.fullmatch(x.loose(of.order), line)
        head = re.search(x.loose(*of.headings), line)
        new = "" if lone else (clean if first else margin)(line[: head.start()]) if head else margin(line)
        if new:
            said.append(new)
            told = told or (len(new) >= of.least and not re.fullmatch(x.loose(*of.headings), new))
        if told and (lone or head):
            break
    text = clean(" | ".join(said))
    if m := re.search(of.opening, text):
        text = clean(text[m.start() :])
    return text


def test_account(spark):
    cases = {
        "before any substance headings, neighbours and a lone order are passed over": (["사건 개요: x", "사 고 경 위", "교 훈", "사건개요", "주 문", "ㅇ 어선 갑호는 출항하였다.", "주문 을호와 부딪쳤다.", "주문", "견책한다."], "ㅇ"),
        "a heading inside a line ends after what precedes it": (["사고경위 : 배가 침몰하였다. 원인판단 과실", "더"], "배가"),
    }
    assert run(spark, [cases[k][0] for k in cases], x.account, "array<string>") == ["어선 갑호는 출항하였다. | 을호와 부딪쳤다.", "배가 침몰하였다."]
    r, parts = random.Random(7), ["사고경위", "사 고경위 갑호는 2023 출항", "주 문", "주문 쪽으로", "교훈", "배가 암초에 부딪쳐 원 인 판단 함", "일시", "장 소", "짧다", "을호는 2021. 3. 안개 속에서 갔다", "□ - 가. 항해사가 당직 중", "ㅇ 병호는 섰다", "판시사항"]
    docs = [[r.choice(parts) for _ in range(r.randrange(12))] for _ in range(400)]
    assert run(spark, docs, x.account, "array<string>") == [by_hand(d, A) for d in docs]
    long = ["사고경위"] + ["배가 북쪽으로 나아갔다"] * 40_000 + ["교훈", "아님"]
    assert run(spark, [long, None, [], [""]], x.account, "array<string>") == [by_hand(long, A), "", "", ""]


def test_overview(spark):
    cases = {
        "판시요지 가. 선박이 판 시 사 항 충돌한 것 나. 둘째": "선박이 충돌한 것",
        "1. 판시사항 가. 판시사항 갑호가 침몰한 사안 2. 관련법규": "갑호가 침몰한 사안",
        "가. 을호가 주 문 좌초한 사건 원인판단": "을호가 좌초한 사건",
        "관 련 선 박: 갑호 어선 10톤 □ 일 시 2023": "관련선박: 갑호 어선 10톤",
        "관련선박 갑호": "",
        "": "",
        None: "",
    }
    assert run(spark, cases, x.overview) == list(cases.values())


def test_dates(spark):
    cases = [["2019. 1. 1. 01:01", "일 시: 2023.7.8.13.:30", "x"], ["일시", "2023년 8월 23일 05시 55"], ["일지 2023. 13. 1. 1:1", "뒤 2020. 2. 3. 4:5"], ["2020. 2. 30. 4:5"], ["없다"], []]
    assert run(spark, cases, x.occurred, "array<string>") == ["2023. 7. 8. 13:30경", "2023년 8월 23일 05시 55분", "", "2020. 2. 30. 04:05경", "", ""]


def test_report(spark):
    text = "가. 갑호가 침몰한 사건 나. 다음\n일시: 2023. 7. 8. 13:30\n장 소: 북위 34m 59분 1% - 128도 3 2 7초 ( 부산 해상 )\n사고경위: 갑호가 침몰한 사건\n교훈"
    got = run(spark, [text, None, "", text * 3000], x.report)
    assert tuple(got[0]) == ("", "2023. 7. 8. 13:30경", "북위 34도 59분 1초 동경 128도 3분 7초 (부산 해상)", "갑호가 침몰한 사건")
    assert tuple(got[1]) == tuple(got[2]) == ("", "", "", "") and got[3].occurred == got[0].occurred and got[3].account.startswith(got[0].account)


def test_positions(spark):
    cases = {"북위 34도 05분 1초 · 동경 128도 3분 70초": (["34", "05", "1", "128", "3", "70"], ""), "북위 1 2 3 동경 4 5 6 (동해상)": (["1", "2", "3", "4", "5", "6"], "동해상"), "북위 34도": None, "": None, None: None}
    got = run(spark, cases, extraction.position)
    assert [g and (g.numbers, g.sea) for g in got] == list(cases.values())
    assert run(spark, cases, extraction.position_suspect) == [True, False, False, False, False]
