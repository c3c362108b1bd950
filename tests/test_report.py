"""Source bundle and report against a plain reading of their rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from filingframe.operators.windows import news_entry
from filingframe.plans import report as RP

from .test_operators import kept_titles

DAY = datetime.date(2025, 3, 1)
NEWS = "issuer string, ord long, date date, title string, content string"


def plain_bundle(report, research, news, max_body=800, max_total=15_000):
    """One issuer's bundle; ``news`` are (ord, date, title, content)."""
    kept = set(kept_titles([(o, t) for o, _, t, _ in news]))
    lines, used = [], 0
    for o, date, title, content in sorted(news):
        if o not in kept or not title or used >= max_total:
            continue
        entry = f"- [{date or ''}] {title}"
        if content:
            entry += "\n  " + content[:max_body] + ("..." if len(content) > max_body else "")
        lines.append(entry)
        used += len(entry)
    sections = [f"### 자동 생성된 재무 분석 보고서 (섹션 1~4)\n\n{report}"] if report else []
    sections += [f"### 리서치 리포트: {name}\n\n{text}" for name, text in sorted(research) if text]
    if lines:
        sections.append("### 최근 뉴스\n\n" + "\n".join(lines))
    return "\n\n---\n\n".join(sections)


def made(seed):
    rng = random.Random(seed)
    words = ["공급계약", "체결", "실적", "발표", "주요사항보고서", "[속보] ", "a", "【단독】"]
    title = lambda: rng.choice([None, "", " ", "".join(rng.choice(words) for _ in range(rng.randint(1, 6)))])
    body = lambda: rng.choice([None, "", "본문" * rng.choice([3, 399, 401, 900])])
    issuers = {}
    for issuer in "abcd":
        news = [(i, rng.choice([None, DAY + datetime.timedelta(i % 9)]), title(), body()) for i in range(rng.choice([0, 30, 160]))]
        research = [(f"r{i:03d}.pdf", rng.choice(["", "x" * 6000])) for i in range(rng.randint(0, 5))]
        issuers[issuer] = rng.choice(["", "# report"]), research, news
    issuers["whole"] = "# r", [(f"f{i}.pdf", "긴 글 " * 2000) for i in range(4)], [(1, DAY, "하나의 소식입니다", "x" * 900), (2, DAY, "다른 소식입니다요", None)]
    issuers["news"] = "", [], [(1, None, "t", None)]
    return issuers


def frames(spark, issuers):
    reports = spark.createDataFrame([(i, v[0]) for i, v in issuers.items()], "issuer string, report_text string")
    research = spark.createDataFrame([(i, *r) for i, v in issuers.items() for r in v[1]], "issuer string, file string, text string")
    news = spark.createDataFrame([(i, *n) for i, v in issuers.items() for n in v[2]], NEWS).repartition(5)
    return reports, research, news


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bundle(spark, seed):
    issuers = made(seed)
    reports, research, news = frames(spark, issuers)
    rows = RP.bundle_rows(reports, research, RP.news_digest(news))
    got = {r["issuer"]: r["sources_content"] for r in RP.source_bundle(rows).collect()}
    want = {i: plain_bundle(*v) for i, v in issuers.items()}
    assert got == {i: t for i, t in want.items() if t}
    joined = {}
    for r in sorted(rows.collect(), key=lambda r: (r["issuer"], r["part"], r["key"])):
        joined[r["issuer"]] = joined[r["issuer"]] + r["joint"] + r["text"] if r["issuer"] in joined else r["text"]
    assert joined == got
    coarse = RP.source_bundle(rows, slot=F.lit(""))
    assert {r["issuer"]: r["sources_content"] for r in coarse.collect()} == got


def test_research_does_not_use_up_the_news(spark):
    """Research alone is longer than the budget; every text and every piece of news is there."""
    issuers = {"a": made(1)["whole"]}
    reports, research, news = frames(spark, issuers)
    (row,) = RP.source_bundle(RP.bundle_rows(reports, research, RP.news_digest(news))).collect()
    assert len(row["sources_content"]) > 30_000
    assert row["sources_content"].count("### 리서치 리포트") == 4 and row["sources_content"].count("- [2025-03-01]") == 2


def test_budget_is_that_of_the_news(spark):
    news = [("a", i, DAY, f"소식 제목 번호 {i:04d}", "가" * 2000) for i in range(100)] + [("b", i, None, f"t{i}", None) for i in range(3000)]
    df = spark.createDataFrame(news, NEWS)
    got = {r["issuer"]: r["n"] for r in RP.news_digest(df).groupBy("issuer").agg(F.count("*").alias("n")).collect()}
    plain = lambda i: plain_bundle("", [], [n[1:] for n in news if n[0] == i]).count("\n- [") + 1
    assert got == {"a": plain("a") - 1, "b": plain("b") - 1}
    assert spark.createDataFrame([(None, "t", "x")], "date date, title string, content string").select(news_entry()).first()[0] == "- [] t\n  x"


def test_report_keeps_every_contract_and_instrument(spark):
    """25 contracts and 60 instruments beside a record of five years at most."""
    spark_range = lambda n: spark.range(n).select(F.lit("a").alias("issuer"), F.col("id").alias("ord"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("cell"))
    years = spark_range(9).withColumnRenamed("ord", "fy")
    record = RP.assemble_report(years.select("issuer").distinct(), [], {"years": (years, ["fy"], 5)})
    lines = RP.report_rows(record, [], ["years"])
    for name, n in (("contracts", 25), ("overhang", 60)):
        lines = lines.unionByName(RP.detail_lines(spark_range(n), name, order=["ord"], slot=F.floor(F.col("ord") / 7)))
    got = {}
    for r in lines.collect():
        got.setdefault(r["section"], []).append((r["pos"], r["row"]))
    assert sorted(got["years"]) == [(i + 1, f"{4 + i}|c{4 + i}") for i in range(5)]
    assert sorted(got["contracts"]) == [(i + 1, f"{i}|c{i}") for i in range(25)]
    assert sorted(got["overhang"]) == [(i + 1, f"{i}|c{i}") for i in range(60)]


def test_bodies_are_clipped_before_the_titles_join(spark, monkeypatch):
    """The join with the titles that stay carries entries, no whole body."""
    rows = [("a", i, DAY, f"title number {i}", "x" * 2000) for i in range(3)]
    joined = []
    monkeypatch.setattr(RP, "containment_dedup", lambda news, **_: joined.append(news) or news)
    RP.news_digest(spark.createDataFrame(rows, NEWS))
    assert "content" not in joined[0].columns
    assert [len(r.entry) for r in joined[0].collect()] == [len("- [2025-03-01] title number 0\n  ") + 800 + len("...")] * 3
