"""Operators whose result depends on order, and sources, sinks and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from filingframe.operators import aggregates as A
from filingframe.operators import joins as J
from filingframe.operators import windows as W
from filingframe.operators import years as Y
from filingframe.session import scratch_path
from filingframe.sources import readers as R
from filingframe.sources import sinks as SK
from filingframe.streaming import ingest as I

MS = ["revenue", "operating_income", "net_income"]


def kept_titles(rows):
    """Plain reading of the greedy rule."""
    seen, kept = [], []
    for ord_, title in sorted(rows):
        norm = re.sub(r"\s+", "", re.sub(r"\[.*?\]|【.*?】", "", title or ""))
        if not norm:
            continue
        if any((norm in s or s in norm) and min(len(norm), len(s)) >= 8 for s in seen):
            continue
        seen.append(norm)
        kept.append(ord_)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_dedup(spark, seed):
    rnd = random.Random(seed)
    words = ["주요사항보고서", "공급계약", "체결", "삼성전자", "실적", "발표", "ab"]
    rows = []
    for block in ("a", "b"):
        for i in range(150):
            t = "".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
            rows.append((block, i, rnd.choice(["", "[속보] ", "【단독】"]) + t))
    rows += [("c", i, "주요사항보고서공시" + "x" * i) for i in range(40)]  # one long chain of nested titles
    pieces = [f"{i:08d}" for i in range(501)]
    for i in range(500):  # every title overlaps the ones before and after it only
        rows += [("z", 2 * i, pieces[i]), ("z", 2 * i + 1, pieces[i] + "-" + pieces[i + 1])]
    df = spark.createDataFrame(rows, "block string, ord bigint, title string").repartition(5)
    got = {(r.block, r.ord) for r in J.containment_dedup(df, block=["block"], order="ord", title="title").collect()}
    want = {(b, o) for b in "abcz" for o in kept_titles([(o, t) for bb, o, t in rows if bb == b])}
    assert got == want


def test_running_sum_over_slots(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else "k", i // 7, i, rnd.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, day bigint, ord bigint, v bigint")
    out = W.running_sum(df, keys=["k"], order=["ord"], value="v", slot=F.col("day"), out="before")
    got = {r.ord: r.before for r in out.collect()}
    for key in ("hot", "k"):
        total = 0
        for k, _, o, v in rows:
            if k == key:
                assert got[o] == total
                total += v


def frame(spark, rows):
    return spark.createDataFrame(rows, "issuer bigint, fy bigint, fq bigint, revenue bigint, operating_income bigint, net_income bigint")


def test_standalone_quarters(spark):
    ytd = frame(spark, [(1, 2024, 1, 200, 10, None), (1, 2024, 2, 500, None, 5), (1, 2024, 3, 700, 30, 9), (1, 2024, 4, 580, 40, 10), (2, 2024, 1, None, None, None), (2, 2024, 2, 70, 7, 1)])
    got = {(r.issuer, r.fq): (r.revenue, r.operating_income, r.net_income) for r in Y.standalone_from_cumulative(ytd, measures=MS).collect()}
    assert got[1, 2] == (300, None, None) and got[1, 3] == (200, None, 4) and got[1, 4] == (-120, 10, 1)
    assert got[2, 2] == (70, 7, 1)


def test_ytd_rules(spark):
    rows = [(1, 2024, q, v, v, v) for q, v in ((1, 759), (2, 613), (3, 679))] + [(1, 2023, q, 600, 600, 600) for q in (1, 2, 3)]
    rows += [(2, 2024, 4, 1, 1, 1)] + [(3, 2024, 2, 5, None, 5), (3, 2024, 3, 6, 6, None)]
    got = {r.issuer: r for r in A.ytd_sum_with_gap_rule(frame(spark, rows), measures=MS).collect()}
    assert got[1].revenue == 2051 and got[1].prev_revenue == 1800 and 2 not in got
    assert (got[3].revenue, got[3].operating_income, got[3].net_income) == (11, 6, None)


@pytest.mark.parametrize("amounts,scale", [(["5,000,000", "3,000,000"], 1_000_000), (["5,000,000", "3,000,001"], 1), (["5,000,000"], 1), (["5,000,000", "3,000,000", "500"], 1_000_000)])
def test_unit_inflation(spark, amounts, scale):
    df = spark.createDataFrame([(1, "IS", a) for a in amounts] + [(1, "BS", "123,457")], "issuer bigint, sj_div string, amount string")
    assert A.detect_unit_inflation(df, keys=["issuer"]).first().scale == scale


def test_shuffled_lines_give_the_same_pivot(spark):
    from filingframe import lexicon as lx

    rows = [(1, i, "BS", n, a) for i, (n, a) in enumerate([("유동성전환사채", "1"), ("사채", "-"), ("비유동사채", "7"), ("자본과부채총계", "3"), ("자산총계", "9"), ("자산총계", "8")])]
    schema = "issuer bigint, ord bigint, sj_div string, account_nm string, amount string"
    pick = lambda df: A.pivot_accounts(df, keys=["issuer"], rules=lx.BALANCE_LABELS, statements=["BS"]).first()
    a, b = pick(spark.createDataFrame(rows, schema)), pick(spark.createDataFrame(rows[::-1], schema).repartition(3))
    # an unreadable amount under the exact label is final; excluded words never match
    assert a == b and a.total_assets == 9 and a.bonds is None and a.total_liabilities is None


def test_files(spark, tmp_path):
    (tmp_path / "codes.json").write_text('{\n "5930": " 삼성전자 ",\n "0004V0": "코넥스", "12345678": "긴코드"}', encoding="utf-8")
    got = {r.code: r.name for r in R.read_code_map(spark, str(tmp_path / "codes.json")).collect()}
    assert got == {"005930": "삼성전자", "0004V0": "코넥스", "12345678": "긴코드"}
    (tmp_path / "list.csv").write_bytes("a,b,code,name\r\n1,2,'5930,한글주식회사\r\n1,2,,x\r\n".encode("cp949"))
    assert [tuple(r) for r in R.read_legacy_csv(spark, str(tmp_path / "list.csv")).collect()] == [("005930", "한글주식회사")]
    (tmp_path / "e.json").write_text('[{"date":"1","title":"t","url":"u"},{"title":"x"}]', encoding="utf-8")
    assert [r.url for r in R.read_disclosure_entries(spark, str(tmp_path / "e.json")).collect()] == ["u"]
    (tmp_path / "u.txt").write_text(" http://a \nnope\nhttps://b\n", encoding="utf-8")
    assert {r.url for r in R.read_url_lines(spark, str(tmp_path / "u.txt")).collect()} == {"http://a", "https://b"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_bytes("<meta charset=euc-kr>가나".encode("euc-kr"))
    (tmp_path / "d" / "b.html").write_bytes("가나 \xff".encode("utf-8") + b"\xff")
    docs = {r.path[-6:]: (r.text, r.encoding) for r in R.read_documents(spark, str(tmp_path / "d")).collect()}
    assert docs["a.html"] == ("<meta charset=euc-kr>가나", "cp949") and docs["b.html"][1] == "cp949"


def test_sinks_replace_only_their_partitions(spark):
    path = scratch_path(spark, "json")
    df = spark.createDataFrame([("a", "2024-01-01", "u1"), ("b", "2024-01-01", "u2")], "issuer string, run_date string, url string")
    SK.write_dated_json(df, path, urls_path=path + "-urls")
    SK.write_dated_json(df.where("issuer = 'a'").withColumn("url", F.lit("u3")), path)
    assert {(r.issuer, r.url) for r in spark.read.json(path).collect()} == {("a", "u3"), ("b", "u2")}
    assert {r.value for r in spark.read.text(path + "-urls").collect()} == {"u1", "u2"}


@pytest.mark.parametrize("min_chars,hot", [(8, 4096), (8, 2), (5, 3), (1, 2)])
def test_containment_pairs(spark, min_chars, hot):
    """Titles of any length, one phrase in most of them, titles that are that phrase, very long ones."""
    rnd = random.Random(min_chars + hot)
    words = ["공급계약체결", "ab", "a", "실적", "주요사항보고서제출", "x" * 40]
    titles = {("h", "주요사항보고서제출")} | {("h", "주요사항보고서제출" + "".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))) for _ in range(60)}
    titles |= {(b, "".join(rnd.choice(words) for _ in range(rnd.randint(1, 8)))) for b in "ab" for _ in range(60)}
    titles |= {("l", "".join(rnd.choice("abc") for _ in range(n))) for n in (8, 9, 4200, 9000, 20_000)}
    long = max((t for b, t in titles if b == "l"), key=len)
    titles |= {("l", long[i : i + n]) for i, n in ((0, 8), (5000, 8), (19_990, 10), (3, 4200), (17, 9001), (400, 63), (900, 64), (1, 255))}
    rows = [(b, i, t) for i, (b, t) in enumerate(sorted(titles))]
    df = spark.createDataFrame(rows, "block string, ord bigint, norm string").repartition(5)
    got = [tuple(r) for r in J.containment_pairs(df, block=["block"], order="ord", norm="norm", min_chars=min_chars, hot=hot).collect()]
    want = {(b, i, j) for b, i, s in rows for c, j, t in rows if b == c and i != j and len(s) >= min_chars and s in t}
    assert len(got) == len(set(got)) and set(got) == want


def test_least_grams_of_windows():
    """The least gram hash of every window, for all widths a title is long enough for; equal grams have equal hashes anywhere."""
    title = "".join(random.Random(5).choices("ab가😀", k=90))
    grams, *wider = [list(map(int, least)) for least in J._least_grams(title, 8)]
    text = [title[i : i + 8] for i in range(len(title) - 7)]
    assert len(grams) == len(text) and len(set(zip(grams, text, strict=True))) == len(set(grams)) == len(set(text))
    widths = [w for w in J._WINDOWS[1:] if w <= len(grams)]
    assert wider == [[min(grams[i : i + w]) for i in range(len(grams) - w + 1)] for w in widths]


def test_containment_pairs_with_a_crowded_sieve(spark, monkeypatch):
    """A sieve that lets most grams through costs rows, not results; titles of one gram, of many and beyond the basic plane."""
    monkeypatch.setattr(J, "_SIEVE_BITS", 15)
    rng = random.Random(6)
    long = ["".join(rng.choices("ab가😀", k=rng.choice((12, 40, 300)))) for _ in range(60)]
    titles = dict.fromkeys(t[i : i + n] for t in long for i, n in ((0, len(t)), (2, 8), (1, 9), (3, len(t) // 2)))
    rows = [(b, i, t) for b in (1, 2) for i, t in enumerate(titles) if (i + b) % 5]
    got = J.containment_pairs(spark.createDataFrame(rows, "block int, ord long, norm string"), block=["block"], order="ord", norm="norm")
    want = {(b, i, j) for b, i, s in rows for c, j, t in rows if b == c and i != j and len(s) >= 8 and s in t}
    assert {tuple(r) for r in got.select("block", "short", "long").collect()} == want and len(want) > 100
