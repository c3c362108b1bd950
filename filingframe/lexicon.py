"""Fixed values that the results depend on: labels, rules, multipliers.

Nothing in this module is logic; operators take these tables as default arguments.
"""

# --- fixed values: statement account labels, first match wins --------------------------------
BALANCE_LABELS = {
    "total_assets": ["자산총계"],
    "cash_and_equivalents": ["현금및현금성자산"],
    "short_term_investments": ["단기금융상품"],
    "total_liabilities": ["부채총계"],
    "short_term_debt_and_bonds": [
        "단기차입금및사채", "유동 차입금", "유동차입금", "유동성 차입금", "유동성차입금",
    ],
    "long_term_debt_and_bonds": [
        "장기차입금및사채", "비유동성 차입금", "비유동성차입금", "비유동 차입금", "비유동차입금",
    ],
    "short_term_borrowings": ["단기차입금"],
    "current_long_term_debt": ["유동성장기부채", "유동성장기차입금"],
    "current_bonds": ["유동성사채"],
    "long_term_borrowings": ["장기차입금"],
    "bonds": ["사채"],
    "total_equity": ["자본총계"],
}
BORROWINGS_LABELS = ["차입금"]

INCOME_LABELS = {
    "revenue": ["매출액", "매출", "수익(매출액)", "영업수익", "수익"],
    "operating_income": ["영업이익", "영업이익(손실)", "영업손익", "영업손실"],
    "net_income": [
        "당기순이익", "당기순이익(손실)", "당기순손실(이익)", "당기순손실",
        "당(반)기순이익", "당(반)기순이익(손실)", "당(반)기순손실(이익)",
        "당(분)기순이익", "당(분)기순이익(손실)", "당(분)기순손실(이익)",
        "반기순이익", "반기순이익(손실)", "반기순손실(이익)", "반기순손실",
        "분기순이익", "분기순이익(손실)", "분기순손실(이익)", "분기순손실",
    ],
}

# Words that forbid a substring hit of the label.
LABEL_EXCLUSIONS = {
    "사채": ["유동성", "전환", "할인", "할증", "상환", "교환", "차입금"],
    "차입금": ["장기", "유동성"],
    "장기차입금": ["유동성", "유동"],
    "자본총계": ["부채"],
    "부채총계": ["자본"],
    "매출": ["원가", "총이익", "총손실"],
}

# Labels used on tables read from report pages (row-driven, last row wins).
PAGE_BALANCE_LABELS = {
    "total_assets": ["자산총계"],
    "cash_and_equivalents": ["현금및현금성자산"],
    "short_term_investments": ["단기금융상품"],
    "total_liabilities": ["부채총계"],
    "short_term_debt_and_bonds": [
        "단기차입금및사채", "유동 차입금", "유동차입금", "유동성 차입금", "유동성차입금",
    ],
    "long_term_debt_and_bonds": [
        "장기차입금및사채", "비유동성 차입금", "비유동성차입금", "비유동 차입금",
    ],
    "short_term_borrowings": ["단기차입금", "차입금"],
    "current_long_term_debt": ["유동성장기부채", "유동성장기차입금"],
    "current_bonds": ["유동성사채"],
    "long_term_borrowings": ["장기차입금"],
    "bonds": ["사채"],
    "total_equity": ["자본총계"],
}
PAGE_INCOME_LABELS = {
    "revenue": ["매출액", "수익(매출액)", "영업수익"],
    "operating_income": ["영업이익", "영업이익(손실)", "영업손익", "영업손실"],
    "net_income": [
        "당기순이익", "당기순이익(손실)", "당기순손실(이익)", "당기순손실",
        "반기순이익", "반기순이익(손실)", "반기순손실(이익)", "반기순손실",
        "분기순이익", "분기순이익(손실)", "분기순손실(이익)", "분기순손실",
    ],
}
PAGE_LABEL_EXCLUSIONS = {
    "사채": ["유동성", "전환", "할인", "할증", "상환", "교환", "차입금"],
    "차입금": ["장기"],
    "자본총계": ["부채"],
    "부채총계": ["자본"],
}

# --- fixed values: report codes by fiscal quarter (0 = annual) --------------------------------
REPORT_CODES = {0: "11011", 1: "11013", 2: "11012", 3: "11014"}

# --- fixed values: money units ----------------------------------------------------------------
UNIT_MULTIPLIERS = {"원": 1, "천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000}
DISPLAY_DIVISOR_KRW = 100_000_000
DISPLAY_DIVISOR_OTHER = 1_000_000

# --- fixed values: disclosure title rules, first hit wins -------------------------------------
TITLE_RULES = [
    ("전환가액ㆍ신주인수권행사가액ㆍ교환가액의조정", "convert_price_change"),
    ("신주인수권행사가액의조정", "convert_price_change"),
    ("전환가액의조정", "convert_price_change"),
    ("전환청구권ㆍ신주인수권ㆍ교환청구권행사", "convert"),
    ("전환청구권행사", "convert"),
    ("신주인수권행사", "convert"),
    ("주식매수선택권행사", "convert"),
    ("단일판매ㆍ공급계약체결", "contract"),
    ("단일판매ㆍ공급계약해지", "contract"),
    ("매출액또는손익구조30%(대규모법인은15%)이상변동", "performance"),
    ("매출액또는손익구조", "performance"),
    ("전환사채권 발행결정", "issue"),
    ("신주인수권부사채권 발행결정", "issue"),
    ("자본으로인정되는채무증권 발행결정", "issue"),
    ("자본으로인정되는채무증권발행결정", "issue"),
    ("유무상증자결정", "rights_issue"),
    ("유상증자결정", "rights_issue"),
]

# --- fixed values: footnotes that mark an instrument as gone ----------------------------------
INACTIVE_PATTERNS = [
    r"모두\s*보통주로\s*전환", r"전액\s*상환", r"전액\s*전환", r"전부\s*전환",
    r"전환.*완료", r"상환.*완료",
]

# --- fixed values: Korean number words --------------------------------------------------------
DIGIT_WORDS = {"일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
UNIT_WORDS = {"십": 10, "백": 100, "천": 1_000}
GROUP_WORDS = {"만": 10_000, "억": 100_000_000, "조": 1_000_000_000_000}

# --- fixed values: YoY wording ----------------------------------------------------------------
TURN_PROFIT, TURN_LOSS = "흑자전환", "적자전환"
LOSS_NARROWED, LOSS_WIDENED, LOSS_SAME = "적자축소", "적자확대", "적자지속"

# --- fixed values: funding purpose columns ----------------------------------------------------
FUNDING_EVENT = ["fdpp_fclt", "fdpp_bsninh", "fdpp_op", "fdpp_dae", "fdpp_etc"]
FUNDING_DECISION = ["fdpp_fclt", "fdpp_bsninh", "fdpp_op", "fdpp_dtrp", "fdpp_ocsa", "fdpp_etc"]

# --- fixed values: keywords that mark dilution passages in notes ------------------------------
OVERHANG_KEYWORDS = [
    "전환사채", "신주인수권부사채", "전환우선주", "상환전환우선주",
    "전환상환우선주", "주식매수선택권", "주식기준보상",
]

# --- fixed values: captions of filing forms, by job and field, in the order they are looked for ---
FILING_CAPTIONS = {
    "filing_exercises": {
        "cumulative_shares": ("1. 전환청구권 행사주식수 누계 (주) (기 신고된 주식수량 제외)", "전환청구권 행사주식수 누계", "행사주식수 누계"),
        "total_shares": ("-발행주식총수(주)", "발행주식총수", "발행주식총수(주)"),
        "ratio_pct": ("-발행주식총수 대비(%)", "발행주식총수 대비(%)", "발행주식총수 대비"),
    },
    "filing_claims": {
        "date": ("청구일자", "청구일", "행사일자", "행사일"),
        "series": ("회차",),
        "bond_type": ("종류",),
        "amount": ("청구금액", "행사금액"),
        "conversion_price": ("전환가액", "행사가액"),
        "shares": ("발행한 주식수", "발행주식수", "주식수"),
        "listing_date": ("상장일 또는 예정일", "상장예정일", "상장일"),
    },
    "filing_balances": {
        "series": ("회차",),
        "face_value": ("발행당시 사채의 권면(전자등록)총액", "사채의 권면총액", "권면총액"),
        "currency": ("통화단위",),
        "remaining": ("신고일 현재 미전환사채 잔액", "미전환사채 잔액", "잔액"),
        "conversion_price": ("전환가액(원)", "전환가액"),
        "convertible_shares": ("전환가능 주식수", "전환가능주식수"),
    },
    "filing_price_changes": {
        "company": ("회사명", "발행회사"),
        "disclosure_date": ("공시일", "보고일"),
        "series": ("회차",),
        "listed": ("상장여부",),
        "price_before": ("조정전 전환가액 (원)", "조정전 전환가액", "조정전가액"),
        "price_after": ("조정후 전환가액 (원)", "조정후 전환가액", "조정후가액"),
        "unconverted": ("미전환사채의 권면(전자등록)총액", "미전환사채 권면총액", "미전환사채"),
        "shares_before": ("조정전 전환가능 주식수 (주)", "조정전 전환가능주식수"),
        "shares_after": ("조정후 전환가능 주식수 (주)", "조정후 전환가능주식수"),
    },
    "filing_contracts": {
        "description": ("1. 판매ㆍ공급계약 내용", "판매ㆍ공급계약 내용", "계약 내용"),
        "conditional": ("조건부 계약여부",),
        "confirmed_amount": ("확정 계약금액",),
        "disclosed_amount": ("공시별 계약금액",),
        "total_amount": ("계약금액 합계(원)", "계약금액 합계"),
        "recent_revenue": ("최근 매출액(원)", "최근 매출액"),
        "revenue_ratio_pct": ("매출액 대비(%)", "매출액 대비"),
        "counterparty": ("3. 계약상대방", "계약상대방"),
        "relationship": ("- 회사와의 관계",),
        "region": ("4. 판매ㆍ공급지역국가", "판매ㆍ공급지역국가", "지역국가"),
        "period_start": ("시작일", "계약 시작일"),
        "period_end": ("종료일", "계약 종료일"),
        "contract_date": ("8. 계약(수주)일자", "계약(수주)일자", "계약일자"),
    },
    "performance_records": {
        "statement_type": ("1. 재무제표의 종류", "재무제표의 종류", "재무제표 종류"),
        "period_start": ("- 시작일", "시작일"),
        "period_end": ("- 종료일", "종료일"),
        "reason": ("5. 매출액 또는 손익구조 변동 주요원인", "변동 주요원인"),
    },
    "bond_issuances": {
        "series": ("회차", "사채 회차"),
        "kind": ("종류", "사채의 종류", "1. 사채의 종류"),
        "face_value": ("2. 사채의 권면(전자등록)총액 (원)", "사채의 권면(전자등록)총액 (원)", "사채의 권면총액"),
        "conversion_price": ("전환가액 (원/주)", "전환가액", "행사가액 (원/주)", "행사가액"),
        "convertible_shares": ("주식수", "전환주식수"),
        "share_ratio_pct": ("주식총수 대비 비율(%)", "주식총수 대비 비율"),
        "exercise_start": ("시작일", "전환청구 시작일"),
        "exercise_end": ("종료일", "전환청구 종료일"),
    },
    "rights_issues": {
        "issue_price": ("기타주식 (원)", "기타주식(원)"),
        "conversion_ratio_pct": ("전환비율 (%)", "전환비율(%)"),
        "share_type": ("주식의 내용", "기타주식의 내용"),
        "exercise_start": ("시작일", "전환청구 시작일"),
        "exercise_end": ("종료일", "전환청구 종료일"),
    },
}
