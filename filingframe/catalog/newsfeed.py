"""Queries on news, pages, files, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..documents import news as NW
from ..documents import sections as SE
from ..functions import text as TX
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import predicates as P
from ..operators import sets as U
from ..operators import windows as W
from ..plans import report as RP
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as SK
from ..sources import store as SO
from . import proxies as X
from .registry import query
from .texts import cat, pick

NEWS = "WITH " + X.NEWS_SQL
DISC = "WITH " + X.DISC_SQL
DAY = "strftime({}, '%Y-%m-%d')"


# -- predicates ----------------------------------------------------------------------------------


@query("p1_any_keyword", "SELECT doc_id, regexp_matches(lower(text), 'the|que|und ') ci, contains(text,'The') OR contains(text,'(') OR contains(text,'Que') cs FROM documents")
def p1(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", P.any_keyword("text", ["THE", "Que", "und "]).alias("ci"), P.any_keyword("text", ["The", "(", "Que"], ci=False).alias("cs"))


_TITLE_CASE = " ".join(f"WHEN contains(t,'{''.join(w.split())}') THEN '{label}'" for w, label in lx.TITLE_RULES)
_TITLES = [w for w, _ in lx.TITLE_RULES] + ["기타 경영사항", "전환가액의 조정 전환청구권 행사"]
_TITLE_LIST = "[" + ",".join(f"'{t}'" for t in _TITLES) + "]"


@query(
    "p2_classify_first_match",
    f"WITH t AS (SELECT doc_id, {_TITLE_LIST}[doc_id%{len(_TITLES)}+1]||' ('||lang||')' title FROM documents) SELECT doc_id, CASE {_TITLE_CASE} ELSE 'unknown' END category FROM (SELECT doc_id, regexp_replace(title,'\\s','','g') t FROM t) x",
)
def p2(spark, sf):
    t = cat(pick(F.col("doc_id") % len(_TITLES), _TITLES), " (", F.col("lang"), ")")
    return X.table(spark, sf, "documents").select("doc_id", P.classify_first_match(t).alias("category"))


_HEADS = ["전환가액의조정", "전환청구권행사", "단일판매ㆍ공급계약체결", "영업(잠정)실적", "영업실적등에대한전망(공정공시)", "매출액또는손익구조30%변동", "가액 조정", "기타", "기타", "기타", "기타"]
_ROWS = ["", "", "", "", "", "", "", "해지금액 1", "조정전 조정후", "미잔액", "무관"]
_CATS = ["price_adj", "exercise", "backlog", "preliminary", "forecast", "sales", "price_adj", "backlog", "price_adj", "exercise", "unknown"]


@query("p3_classify_heading", f"SELECT doc_id, [{','.join(repr(c) for c in _CATS)}][doc_id%11+1] category FROM documents")
def p3(spark, sf):
    n = F.col("doc_id") % 11
    return X.table(spark, sf, "documents").select("doc_id", P.classify_heading(pick(n, _HEADS), F.array(F.lit("x"), pick(n, _ROWS))).alias("category"))


_REPORTS = ["사업보고서 (2024.12)", "[첨부정정]사업보고서 (2024.12)", "분기보고서 (2025.03)", "반기보고서 (2025.06)", "주요사항보고서"]


@query("p14_periodic_reports", "SELECT doc_id, doc_id%5<4 AS periodic, doc_id%5 IN (0,2,3) AS no_attachment, doc_id%5 IN (0,1,3) AS no_quarter FROM documents")
def p14(spark, sf):
    name = pick(F.col("doc_id") % 5, _REPORTS)
    return X.table(spark, sf, "documents").select(
        "doc_id", P.periodic_reports(name).alias("periodic"), P.periodic_reports(name, drop=["첨부정정"]).alias("no_attachment"),
        P.periodic_reports(name, kinds=["사업보고서", "반기보고서"]).alias("no_quarter"),
    )


_SECT = ["1. 사업의 개요", "4.(금융업) 매출 및 수주상황", "2. 주요 제품", "4. 매출 및 수주상황", "5. 기타"]


@query(
    "p15_find_section",
    "WITH s AS (SELECT source, doc_id, ['1. 사업의 개요','4.(금융업) 매출 및 수주상황','2. 주요 제품','4. 매출 및 수주상황','5. 기타'][doc_id%5+1] title FROM documents), r AS (SELECT *, CASE WHEN contains(title,'매출') THEN 0 WHEN contains(title,'개요') THEN 1 END rk FROM s)"
    " SELECT source, title section_title, doc_id FROM r WHERE rk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY rk, doc_id)=1",
)
def p15(spark, sf):
    d = X.table(spark, sf, "documents").select("source", "doc_id", pick(F.col("doc_id") % 5, _SECT).alias("title"), F.col("doc_id").alias("pos"))
    return P.find_section(d, keys=["source"], title="title", order="pos", keywords=["매출및수주상황", "사업의개요"], value="doc_id")


@query("p17_min_size", "SELECT doc_id FROM documents WHERE length(text)>1000")
def p17(spark, sf):
    return X.table(spark, sf, "documents").where(P.min_size("text", 1000)).select("doc_id")


# -- near-equal titles ---------------------------------------------------------------------------

_NORM = "regexp_replace(regexp_replace(title,'\\[.*?\\]|【.*?】','','g'),'\\s','','g')"
_TITLED = NEWS + f""", t0 AS (SELECT issuer, ord, CASE WHEN ord%3=0 THEN substring(title,1,CAST(14+ord%9 AS INTEGER)) ELSE title END title FROM news),
 t AS (SELECT issuer, ord, {_NORM} n FROM t0), f AS (SELECT issuer, n, min(ord) ord FROM t WHERE length(n)>=8 GROUP BY ALL)"""


def _titled(spark, sf):
    n = X.news(spark, sf)
    cut = F.substring(F.col("title"), F.lit(1), (F.col("ord") % 9 + 14).cast("int"))
    return n.withColumn("title", F.when(F.col("ord") % 3 == 0, cut).otherwise(F.col("title")))


@query("j5_containment_pairs", _TITLED + " SELECT a.issuer, a.ord AS short, b.ord AS long FROM f a JOIN f b ON a.issuer=b.issuer AND a.ord<>b.ord AND contains(b.n, a.n)")
def j5p(spark, sf):
    bare = F.regexp_replace("title", r"\[.*?\]|【.*?】", "")
    t = _titled(spark, sf).select("issuer", "ord", TX.squeeze(bare).alias("norm")).where(F.length("norm") >= 8)
    first = t.groupBy("issuer", "norm").agg(F.min("ord").alias("ord"))
    return J.containment_pairs(first, block=["issuer"], order="ord", norm="norm")


@query(
    "j5_containment_dedup",
    _TITLED.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT issuer, list({'o':ord,'n':n} ORDER BY ord) l FROM t WHERE n<>'' GROUP BY issuer),
    w AS (SELECT issuer, l, 1 i, []::BIGINT[] kept, []::VARCHAR[] seen FROM m
      UNION ALL SELECT issuer, l, i+1,
        CASE WHEN len(list_filter(seen, lambda s: (contains(s,l[i].n) OR contains(l[i].n,s)) AND least(length(s),length(l[i].n))>=8))>0 THEN kept ELSE list_append(kept, l[i].o) END,
        CASE WHEN len(list_filter(seen, lambda s: (contains(s,l[i].n) OR contains(l[i].n,s)) AND least(length(s),length(l[i].n))>=8))>0 THEN seen ELSE list_append(seen, l[i].n) END
      FROM w WHERE i<=len(l))
    SELECT issuer, unnest(kept) ord FROM w WHERE i=len(l)+1""",
)
def j5(spark, sf):
    return J.containment_dedup(_titled(spark, sf), block=["issuer"], order="ord", title="title").select("issuer", "ord")


# -- sets ----------------------------------------------------------------------------------------


@query("u1_union_sources", NEWS + " SELECT 'wire' source, ord, title, \"content\" body FROM news WHERE lang='en' UNION ALL SELECT 'blog', ord, title, NULL FROM news WHERE lang='fr'")
def u1(spark, sf):
    n = X.news(spark, sf)
    wire = n.where("lang = 'en'").select("ord", "title", F.col("content").alias("body"))
    blog = n.where("lang = 'fr'").select("ord", "title")
    return U.union_sources({"wire": wire, "blog": blog})


@query("u2_distinct_by_url", NEWS + " SELECT url, min(ord) ord, arg_max(title, ord) title FROM news GROUP BY url")
def u2(spark, sf):
    return U.distinct_by_url(X.news(spark, sf).select("url", "ord", "title"))


@query("u3_ordered_union", "SELECT doc_id, array_to_string(CASE WHEN lang=source THEN [lang] ELSE [lang, source] END || ['x'], ',') tags, CASE WHEN doc_id%2=0 THEN lang||','||source ELSE lang||','||source END top2 FROM documents")
def u3(spark, sf):
    a = F.array("lang", "source")
    b = F.array("source", F.lit("x"), "lang")
    return X.table(spark, sf, "documents").select(
        "doc_id", F.array_join(U.ordered_union(a, b), ",").alias("tags"), F.array_join(U.ordered_union(a, b, 2), ",").alias("top2")
    )


_MD = "'---'||chr(10)||'created: 2024'||chr(10)||'---'||chr(10)||'intro '||lang||chr(10)||'## 1. 기본사항'||chr(10)||source||chr(10)||'## 5. 투자 아이디어'||chr(10)||CASE WHEN doc_id%2=0 THEN 'idea '||doc_id ELSE '' END||chr(10)||'## 9. 메모'||chr(10)||'user '||doc_id||chr(10)"


def _markdown(spark, sf):
    n = F.col("doc_id")
    idea = F.when(n % 2 == 0, cat("idea ", n)).otherwise("")
    md = cat("---\ncreated: 2024\n---\nintro ", F.col("lang"), "\n## 1. 기본사항\n", F.col("source"), "\n## 5. 투자 아이디어\n", idea, "\n## 9. 메모\nuser ", n, "\n")
    return X.table(spark, sf, "documents").select("doc_id", md.alias("text"))


@query(
    "h12_split_sections",
    """SELECT doc_id, 0 ord, '__frontmatter__' header, '---'||chr(10)||'created: 2024'||chr(10)||'---'||chr(10) body FROM documents UNION ALL SELECT doc_id,1,'__preamble__','intro '||lang FROM documents
    UNION ALL SELECT doc_id,2,'## 1. 기본사항',source FROM documents UNION ALL SELECT doc_id,3,'## 5. 투자 아이디어',CASE WHEN doc_id%2=0 THEN 'idea '||doc_id ELSE '' END FROM documents
    UNION ALL SELECT doc_id,4,'## 9. 메모','user '||doc_id||chr(10) FROM documents""",
)
def h12(spark, sf):
    return SE.split_sections(_markdown(spark, sf), keys=["doc_id"])


@query(
    "u4_merge_sections",
    """SELECT doc_id, '## 1. 기본사항' header, 0 part, 'new '||lang body, 'replaced' AS action FROM documents UNION ALL
    SELECT doc_id,'## 5. 투자 아이디어',0,CASE WHEN doc_id%2=0 THEN 'idea '||doc_id ELSE 'fresh' END,CASE WHEN doc_id%2=0 THEN 'kept' ELSE 'replaced' END FROM documents UNION ALL
    SELECT doc_id,'## 7. 결론',0,'end','added' FROM documents UNION ALL SELECT doc_id,'## 9. 메모',1,'user '||doc_id||chr(10),'kept_at_end' FROM documents""",
)
def u4(spark, sf):
    old = SE.split_sections(_markdown(spark, sf), keys=["doc_id"]).where(F.col("header").startswith("## "))
    fresh = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("## 1. 기본사항").alias("header"), cat("new ", F.col("lang")).alias("body")),
        F.struct(F.lit(2).alias("ord"), F.lit("## 5. 투자 아이디어").alias("header"), F.lit("fresh").alias("body")),
        F.struct(F.lit(3).alias("ord"), F.lit("## 7. 결론").alias("header"), F.lit("end").alias("body")),
    )
    new = X.table(spark, sf, "documents").select("doc_id", F.explode(fresh).alias("s")).select("doc_id", "s.*")
    out = U.merge_sections(old, new, keys=["doc_id"], analysis_headers=["## 5. 투자 아이디어"])
    return out.select("doc_id", "header", "part", "body", "action")


@query("h12_analysis_sections", "SELECT doc_id, 'idea '||source investment_ideas, 'econ '||lang risk_structural, 'counter' risk_counter, 'war' risk_tail, 'buy '||doc_id conclusion FROM documents")
def h12a(spark, sf):
    text = cat("```markdown\n## 5. 투자 아이디어\nidea ", F.col("source"), "\n## 6. 리스크 (Bear Case)\n- **구조적 위험**: econ ", F.col("lang"), "\n- **반론**: counter\n- **Tail Risk**: war\n## 7. 결론\nbuy ", F.col("doc_id"), "\n---\n```")
    d = X.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return SE.analysis_sections(d, keys=["doc_id"]).select("doc_id", "investment_ideas", "risk_structural", "risk_counter", "risk_tail", "conclusion")


@query("h12_text_parts", "SELECT doc_id, CASE WHEN doc_id%2=0 THEN 'a'||chr(10)||'소계'||chr(10)||lang||chr(10)||'나. next' ELSE source END kept, '다. 수주 '||source backlog FROM documents")
def h12t(spark, sf):
    n = F.col("doc_id")
    t = F.when(n % 2 == 0, cat("a\n소계\n", F.col("lang"), "\n합계 1\n2\n나. next")).otherwise(F.col("source"))
    b = cat("가. x\n", "다. 수주 ", F.col("source"))
    return X.table(spark, sf, "documents").select("doc_id", SE.strip_summary(t).alias("kept"), SE.backlog_subsection(b).alias("backlog"))


# -- budgets -------------------------------------------------------------------------------------

_ENTRY = "'- ['||strftime(\"date\",'%Y-%m-%d')||'] '||title||CASE WHEN coalesce(\"content\",'')<>'' THEN chr(10)||'  '||substring(\"content\",1,800)||CASE WHEN length(\"content\")>800 THEN '...' ELSE '' END ELSE '' END"


@query(
    "w9_char_budget",
    NEWS + f", e AS (SELECT issuer, ord, \"date\" d, length({_ENTRY}) n FROM news WHERE title<>'') SELECT issuer, ord, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY issuer ORDER BY d, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) b FROM e) x WHERE b<15000",
)
def w9(spark, sf):
    e = X.news(spark, sf).where("title <> ''").select("issuer", "date", "ord", W.news_entry(max_body=800).alias("entry"))
    kept = W.char_budget(e, keys=["issuer"], order=["date", "ord"], text="entry", slot=F.col("date"), max_total=15_000)
    return kept.select("issuer", "ord", F.length("entry").cast("bigint").alias("n"))


@query(
    "w10_first_n_with_content",
    NEWS + " SELECT issuer, ord FROM (SELECT issuer, ord, coalesce(sum(CASE WHEN coalesce(\"content\",'')<>'' THEN 1 ELSE 0 END) OVER (PARTITION BY issuer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) b FROM news) x WHERE b<20",
)
def w10(spark, sf):
    return W.first_n_with_content(X.news(spark, sf), keys=["issuer"], order="ord", content="content").select("issuer", "ord")


@query("o5_clip_text", "SELECT doc_id, CASE WHEN length(text)>300 THEN substring(text,1,300)||'…' ELSE text END clipped, CASE WHEN length(text)>300 AND instr(reverse(substring(text,1,300)),'. ')>0 THEN 1 ELSE 0 END has_break FROM (SELECT doc_id, text FROM documents) d")
def o5(spark, sf):
    d = X.table(spark, sf, "documents")
    at = O.clip_at_break("text", 300, " .")
    return d.select("doc_id", O.clip("text", 300, "…").alias("clipped"), F.when((F.length("text") > 300) & (F.instr(F.reverse(F.substring("text", 1, 300)), ". ") > 0) & (F.length(at) < 300), 1).otherwise(0).alias("has_break"))


def _texts(spark, sf):
    """Report text, research texts and articles of every issuer."""
    n = X.news(spark, sf)
    reports = n.groupBy("issuer").agg(F.concat(F.lit("# "), F.first("issuer"), F.lit(" "), F.count("*").cast("string")).alias("report_text"))
    research = n.select("issuer", F.concat(F.lit("r"), F.lpad(F.col("ord").cast("string"), 12, "0"), F.lit(".pdf")).alias("file"), F.col("title").alias("text"))
    return reports, research, n


_ENTRY_WHOLE = "'- ['||strftime(\"date\",'%Y-%m-%d')||'] '||title||CASE WHEN coalesce(\"content\",'')<>'' THEN chr(10)||'  '||\"content\" ELSE '' END"


@query(
    "e14_source_sections",
    NEWS + f""", sections AS (
      SELECT issuer, 0 part, '' "key", '# '||issuer||' '||count(*) body FROM news GROUP BY issuer
      UNION ALL SELECT issuer, 1, 'r'||lpad(CAST(ord AS VARCHAR),12,'0')||'.pdf', title FROM news WHERE title<>''
      UNION ALL SELECT issuer, 2, strftime("date",'%Y-%m-%d')||' '||lpad(CAST(ord AS VARCHAR),19,'0'), {_ENTRY_WHOLE} FROM news)
    SELECT issuer, part, "key", body FROM sections""",
)
def e14s(spark, sf):
    """Report, research and news texts of every issuer, whole."""
    reports, research, n = _texts(spark, sf)
    return RP.source_sections(reports, research, n.select("issuer", "date", "ord", W.news_entry().alias("entry")))


# Written from the stated rules, not from the operators: the titles met so far are walked one by one.
_DIGEST_SQL = (
    NEWS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  bare AS (SELECT issuer, ord, title, "date", "content",
      regexp_replace(regexp_replace(title, '\\[.*?\\]|【.*?】', '', 'g'), '\\s+', '', 'g') AS norm FROM news),
  met AS (SELECT issuer, list({{'o': ord, 'n': norm}} ORDER BY ord) AS l FROM bare WHERE norm <> '' GROUP BY issuer),
  walk AS (
    SELECT issuer, l, 1 AS i, []::STRUCT(o BIGINT, n VARCHAR)[] AS seen FROM met
    UNION ALL
    SELECT issuer, l, i + 1, CASE WHEN len(list_filter(seen, lambda s: least(length(s.n), length(l[i].n)) >= 8 AND (contains(s.n, l[i].n) OR contains(l[i].n, s.n)))) = 0
      THEN list_append(seen, l[i]) ELSE seen END
    FROM walk WHERE i <= len(l)),
  single AS (SELECT issuer, unnest(list_transform(seen, lambda s: s.o)) AS ord FROM walk WHERE i = len(l) + 1),
  entries AS (SELECT issuer, ord, {_ENTRY} AS entry FROM news SEMI JOIN single USING (issuer, ord) WHERE title <> ''),
  digest AS (
    SELECT issuer, ord, entry FROM (
      SELECT *, coalesce(sum(length(entry)) OVER (PARTITION BY issuer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM entries) WHERE used < 15000)"""
)


@query("e14_news_digest", _DIGEST_SQL + " SELECT issuer, ord, entry FROM digest")
def e14d(spark, sf):
    """News of every issuer without near-equal titles, within 15,000 characters."""
    return RP.news_digest(X.news(spark, sf))


@query(
    "e14_bundle_rows",
    _DIGEST_SQL + """ SELECT issuer, 0 AS part, '' AS "key", '### 자동 생성된 재무 분석 보고서 (섹션 1~4)' || repeat(chr(10), 2) || '# ' || issuer || ' ' || count(*) AS text FROM news GROUP BY issuer
    UNION ALL SELECT issuer, 1, file, '### 리서치 리포트: ' || file || repeat(chr(10), 2) || title
      FROM (SELECT *, 'r' || lpad(CAST(ord AS VARCHAR), 12, '0') || '.pdf' AS file FROM news) f WHERE title <> ''
    UNION ALL SELECT issuer, 2, lpad(CAST(ord AS VARCHAR), 19, '0'),
      CASE WHEN ord = min(ord) OVER (PARTITION BY issuer) THEN '### 최근 뉴스' || repeat(chr(10), 2) ELSE '' END || entry FROM digest""",
)
def e14r(spark, sf):
    """The bundle of every issuer as rows in order."""
    reports, research, n = _texts(spark, sf)
    return RP.bundle_rows(reports, research, RP.news_digest(n)).drop("joint")


@query(
    "e14_source_bundle",
    _DIGEST_SQL + """, parts AS (
      SELECT issuer, 0 AS p, '### 자동 생성된 재무 분석 보고서 (섹션 1~4)' || repeat(chr(10), 2) || '# ' || issuer || ' ' || count(*) AS x FROM news GROUP BY issuer
      UNION ALL SELECT issuer, 1, string_agg('### 리서치 리포트: r' || lpad(CAST(ord AS VARCHAR), 12, '0') || '.pdf' || repeat(chr(10), 2) || title, repeat(chr(10), 2) || '---' || repeat(chr(10), 2) ORDER BY ord)
        FROM news WHERE title <> '' GROUP BY issuer
      UNION ALL SELECT issuer, 2, '### 최근 뉴스' || repeat(chr(10), 2) || string_agg(entry, chr(10) ORDER BY ord) FROM digest GROUP BY issuer)
    SELECT issuer, string_agg(x, repeat(chr(10), 2) || '---' || repeat(chr(10), 2) ORDER BY p) AS sources_content FROM parts GROUP BY issuer""",
)
def e14(spark, sf):
    """The same as one text per issuer: report and research whole, news within its budget."""
    reports, research, n = _texts(spark, sf)
    return RP.source_bundle(RP.bundle_rows(reports, research, RP.news_digest(n)))


# -- sources, files ------------------------------------------------------------------------------


def _one_file_each(rows, path: str) -> None:
    """Every row becomes a text file."""
    rows.write.option("maxRecordsPerFile", 1).text(path)


@query("s3_disclosure_entries", NEWS + " SELECT ord, CASE WHEN ord%4=0 THEN '' WHEN ord%4=1 THEN NULL ELSE url END url FROM news WHERE ord%4>1")
def s3(spark, sf):
    n = X.news(spark, sf)
    url = F.when(F.col("ord") % 4 == 0, F.lit("")).when(F.col("ord") % 4 != 1, F.col("url"))
    entry = F.struct(F.lit("2024-01-01").alias("date"), F.col("ord").cast("string").alias("title"), url.alias("url"), F.col("issuer").alias("source"))
    lists = n.groupBy(F.floor(F.col("ord") / 100)).agg(F.to_json(F.collect_list(entry)).alias("value"))
    path = scratch_path(spark, "entries")
    _one_file_each(lists.select("value"), path)
    return R.read_disclosure_entries(spark, path).select(F.col("title").cast("bigint").alias("ord"), "url")


@query("s4_url_lines", "SELECT url FROM pages")
def s4(spark, sf):
    p = X.table(spark, sf, "pages")
    lines = p.select(F.explode(F.array(cat("  ", F.col("url"), "\t"), cat("# ", F.col("url")), F.lit(""))).alias("value"))
    path = scratch_path(spark, "urls")
    lines.write.text(path)
    return R.read_url_lines(spark, path)


_FILE = "strftime(DATE '2024-01-01'+CAST(ord%60 AS INTEGER),'%Y%m%d')||'_[공시]_'||lpad(CAST(ord%300 AS VARCHAR),14,'0')||'_회사_주요사항보고서('||['유상증자결정','전환사채권발행결정','기타'][ord%3+1]||').pdf'"
_FILE_RE = r"^(\d{8})_\[[^\]]+\]_(\d+)_.*주요사항보고서\((.+?)\)\.pdf$"


def _files(spark, sf):
    n = X.news(spark, sf)
    o = F.col("ord")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (o % 60).cast("int")), "yyyyMMdd")
    name = cat(day, "_[공시]_", F.lpad((o % 300).cast("string"), 14, "0"), "_회사_주요사항보고서(", pick(o % 3, ["유상증자결정", "전환사채권발행결정", "기타"]), ").pdf")
    return n.select("issuer", name.alias("name"))


@query(
    "s9_files_from_names",
    NEWS + f", f AS (SELECT issuer, {_FILE} nm FROM news) SELECT rcept_no, nm AS name, nm[1:8] AS \"date\", regexp_extract(nm,'주요사항보고서\\((.+?)\\)',1) kind FROM (SELECT regexp_extract(nm,'_([0-9]+)_',1) rcept_no, min(nm) nm FROM f GROUP BY 1) x",
)
def s9(spark, sf):
    return R.files_from_names(_files(spark, sf), _FILE_RE).select("rcept_no", "name", "date", "kind")


@query("s10_latest_file", NEWS + f", f AS (SELECT issuer, {_FILE} nm FROM news) SELECT issuer, max(nm) newest, min(nm) AS first_name FROM f GROUP BY issuer")
def s10(spark, sf):
    f = _files(spark, sf)
    new = R.latest_file(f, keys=["issuer"]).withColumnRenamed("name", "newest")
    return new.join(R.latest_file(f, keys=["issuer"], newest=False).withColumnRenamed("name", "first_name"), "issuer")


@query("s13_skip_already_fetched", NEWS + " SELECT DISTINCT url FROM news WHERE url NOT IN (SELECT url FROM news WHERE ord%3=0)")
def s13(spark, sf):
    n = X.news(spark, sf)
    manifest = SO.new_store(spark, scratch_path(spark, "manifest"), keys=["url"])
    for rest in (0, 3):  # the manifest grows by two runs
        SK.append_manifest(n.where(f"ord % 6 = {rest}"), manifest)
    return R.skip_already_fetched(n.select("url"), SO.read(spark, manifest))


@query(
    "h19_news_listing_rows",
    NEWS + ", i AS (SELECT issuer, ord, row_number() OVER (PARTITION BY issuer ORDER BY ord)-1 pos FROM news) SELECT issuer, CAST(pos AS INTEGER) pos, strftime(DATE '2024-01-01'+CAST(ord%60 AS INTEGER),'%Y-%m-%d') AS day, 'T'||ord title, CASE WHEN ord%2=0 THEN 'https://n.example/n/'||ord ELSE 'http://x/'||ord END url FROM i",
)
def h19(spark, sf):
    o = F.col("ord")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (o % 60).cast("int")), "yyyy.MM.dd")
    href = F.when(o % 2 == 0, cat("/n/", o)).otherwise(cat("http://x/", o))
    item = cat('<li><h4 class="titles"><a href="', href, '">T<b>', o, "</b></a></h4><em>", day, " 10:00</em></li>")
    part = F.struct("ord", "item")
    pages = X.news(spark, sf).select("issuer", "ord", item.alias("item")).groupBy("issuer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["item"]), "\n").alias("html"))
    rows = NW.listing_rows(pages, keys=["issuer"], base="https://n.example", source="wire")
    return rows.select("issuer", "pos", F.date_format("date", "yyyy-MM-dd").alias("day"), "title", "url")


@query("s1_read_code_map", "SELECT lpad(CAST(c_custkey AS VARCHAR),6,'0') code, c_name AS name FROM customer")
def s1(spark, sf):
    """Lists of a hundred companies each, as JSON objects."""
    entry = F.struct(cat(" ", F.col("c_custkey")), cat(F.col("c_name"), " "))
    lists = X.table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )
    path = scratch_path(spark, "codes")
    _one_file_each(lists.select("value"), path)
    return R.read_code_map(spark, path)


@query("s2_read_legacy_csv", "SELECT lpad(CAST(s_suppkey AS VARCHAR),6,'0') code, '회사'||s_name AS name FROM supplier WHERE s_suppkey%7<>0")
def s2(spark, sf):
    """Files of a hundred companies each."""
    name = F.when(F.col("s_suppkey") % 7 != 0, cat("회사", F.col("s_name")))
    line = F.concat_ws(",", F.lit("1"), F.lit("KRX"), cat("'", F.col("s_suppkey")), F.coalesce(name, F.lit("")))
    texts = X.table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 100)).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    path = scratch_path(spark, "lists")
    _one_file_each(texts.select(cat("no,market,code,name\n", F.col("body"))), path)
    return R.read_legacy_csv(spark, path)


@query("s8_decode_documents", "SELECT s_suppkey, '<meta charset='||CASE WHEN s_suppkey%2=0 THEN 'euc-kr' ELSE 'utf-8' END||'>회사'||s_name AS text, CASE WHEN s_suppkey%2=0 THEN 'cp949' ELSE 'utf-8' END encoding FROM supplier")
def s8(spark, sf):
    k = F.col("s_suppkey")
    html = cat("<meta charset=", F.when(k % 2 == 0, F.lit("euc-kr")).otherwise("utf-8"), ">회사", F.col("s_name"))

    def encode(batches):
        for b in batches:
            names = ["cp949" if i % 2 == 0 else "utf-8" for i in b["s_suppkey"]]
            yield b.assign(content=[t.encode(n) for t, n in zip(b["text"], names)]).drop(columns=["text"])

    raw = X.table(spark, sf, "supplier").select("s_suppkey", html.alias("text")).mapInPandas(encode, "s_suppkey long, content binary")
    return R.decode_documents(raw).select("s_suppkey", "text", "encoding")


@query("s11_write_dated_json", NEWS + f" SELECT issuer, {DAY.format(chr(34) + 'date' + chr(34))} run_date, ord, url FROM news")
def s11(spark, sf):
    path = scratch_path(spark, "news")
    rows = X.news(spark, sf).select("issuer", F.date_format("date", "yyyyMMdd").alias("run_date"), "ord", "url")
    # one file per partition value instead of one per task and value
    SK.write_dated_json(SK.dashed_date(rows, "run_date").repartition("issuer", "run_date"), path)
    return spark.read.schema("issuer string, run_date string, ord long, url string").json(path).select("issuer", "run_date", "ord", "url")


@query("s12_write_report_rows", DISC + " SELECT issuer, count(*) n, CAST(sum(shares) AS BIGINT) shares FROM disc GROUP BY ALL")
def s12(spark, sf):
    path = scratch_path(spark, "reports")
    parts = F.struct("kind", "shares")
    rows = X.disc(spark, sf).groupBy("issuer", "kind").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))
    nested = rows.groupBy("issuer").agg(F.sum("n").alias("n"), F.collect_list(parts).alias("parts")).withColumn("run_date", F.lit("2024-01-31"))
    for _ in range(2):  # a repeated run replaces its partition
        SK.write_report_rows(nested, path)
    return spark.read.parquet(path).select("issuer", "n", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["shares"]).alias("shares"))


