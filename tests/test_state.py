"""Dilution state against a plain record-by-record reading of the rules, on random logs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from filingframe.dilution import fold, schemas, state

DAYS = [datetime.date(2025, 1, d) for d in range(1, 8)]
FIELDS = ["category", "series", "remaining", "conversion_price", "convertible_shares", "face_value", "exercise_start", "exercise_end"]


class Book:
    """The rules, one record at a time, for one issuer."""

    def __init__(self):
        self.rows = {}

    def put(self, key, **kw):
        base = dict(category="", series=0, kind="", face_value=0, remaining=0, conversion_price=0, convertible_shares=0, exercise_start="", exercise_end="")
        self.rows[key] = {**base, **kw}

    def note(self, r):
        cat = r["category"]
        key = f"{cat}_{r['series']}" if cat in ("CB", "BW", "SO") else "PREF_" + r["kind"].replace(" ", "_")
        if cat == "SO":
            left, shares = 0, r["convertible_shares"]
        else:
            left = r["face_value"] if r["remaining_balance"] is None else r["remaining_balance"]
            shares = r["convertible_shares"] if left > 0 else 0
        self.put(key, category=cat, series=r["series"], kind=r["kind"], face_value=r["face_value"], remaining=left, conversion_price=r["conversion_price"], convertible_shares=shares, exercise_start=r["exercise_start"], exercise_end=r["exercise_end"])

    def event(self, r):
        cat, price, shares, face = r["category"], r["conversion_price"] or 0, r["convertible_shares"] or 0, r["face_value"] or 0
        if cat in ("CB", "BW", "PERPETUAL"):
            key = f"{cat}_{r['series']}"
            s = self.rows.get(key)
            if s:
                s["conversion_price"] = s["conversion_price"] or price
                s["convertible_shares"] = s["convertible_shares"] or shares
                if face and not s["face_value"]:
                    s["face_value"] = s["remaining"] = face
                s["exercise_start"] = s["exercise_start"] or r["cv_start"]
                s["exercise_end"] = s["exercise_end"] or r["cv_end"]
                return
            if not shares and price >= 100:
                shares = face // price
            self.put(key, category="영구채" if cat == "PERPETUAL" else cat, series=r["series"], face_value=face, remaining=face, conversion_price=price, convertible_shares=shares, exercise_start=r["cv_start"], exercise_end=r["cv_end"])
        elif cat == "STOCK_OPTION":
            n = r["shares"] or shares
            if n <= 0:
                return
            p, key = r["exercise_price"] or price, f"SO_{r['series']}"
            s = self.rows.get(key)
            if s:
                s["conversion_price"] = p or s["conversion_price"]
                s["convertible_shares"] = n
                s["exercise_start"] = r["cv_start"] or s["exercise_start"]
                s["exercise_end"] = r["cv_end"] or s["exercise_end"]
                return
            self.put(key, category="주식매수선택권", series=r["series"], conversion_price=p, convertible_shares=n, exercise_start=r["cv_start"], exercise_end=r["cv_end"])
        else:
            n = r["shares"] or 0
            if n <= 0:
                return
            p = price or r["issue_price"] or 0
            if r["rcept_no"]:
                key = f"RIGHTS_{r['rcept_no']}"
                s = self.rows.get(key)
            else:
                key = f"RIGHTS_{r['pdf_date']}"
                s = next((v for k, v in self.rows.items() if k.startswith("RIGHTS_") and v["convertible_shares"] == n), None)
            if s:
                s["conversion_price"] = s["conversion_price"] or p
                s["exercise_start"] = s["exercise_start"] or r["cv_start"]
                s["exercise_end"] = s["exercise_end"] or r["cv_end"]
                return
            self.put(key, category="전환우선주", face_value=face, remaining=face, conversion_price=p, convertible_shares=n, exercise_start=r["cv_start"], exercise_end=r["cv_end"])

    def exercise(self, r):
        if r["type"] == "주식매수선택권행사":
            if (r["new_shares"] or 0) > 0:
                hits = [s for s in self.rows.values() if s["category"] in ("주식매수선택권", "SO")]
                for s in hits:
                    s["convertible_shares"] = r["new_shares"]
                if not hits:
                    self.put("SO_0", category="주식매수선택권", convertible_shares=r["new_shares"])
            return
        if r["exchangeable"]:
            return
        left = r["remaining"] if r["has_remaining"] else r["face_value"]
        cs = r["convertible_shares"] or r["remaining_shares"]
        if r["series"] is not None:
            s = next((v for v in self.rows.values() if v["series"] == r["series"]), None)
        else:
            s = next((v for k, v in self.rows.items() if r["conversion_price"] and k.startswith("RIGHTS_") and v["conversion_price"] == r["conversion_price"]), None)
        if s:
            s["remaining"] = s["remaining"] if left is None else left
            s["conversion_price"] = s["conversion_price"] if r["conversion_price"] is None else r["conversion_price"]
            s["convertible_shares"] = s["convertible_shares"] if cs is None else cs
        elif r["series"] is not None and (left or cs):
            cat = "BW" if "신주인수권" in r["type"] else "CB"
            self.put(f"{cat}_{r['series']}", category=cat, series=r["series"], face_value=r["face_value"] or left or 0, remaining=left or 0, conversion_price=r["conversion_price"] or 0, convertible_shares=cs or 0)

    def adjust(self, r):
        find = lambda f, v: next((s for s in self.rows.values() if (s["series"] == r["series"] if r["series"] is not None else v and s[f] == v)), None)
        if r["part"] == 0:
            p = r["price_after"]
            s = find("conversion_price", r["price_before"]) if p is not None else None
            if s:
                s["conversion_price"] = p
                if p >= 100 and s["remaining"]:
                    s["convertible_shares"] = s["remaining"] // p
            return
        if r["shares_after"] is None and r["unconverted"] is None:
            return
        s = find("convertible_shares", r["shares_before"] or r["current_shares"])
        if s:
            s["convertible_shares"] = s["convertible_shares"] if r["shares_after"] is None else r["shares_after"]
            s["remaining"] = s["remaining"] if r["unconverted"] is None else r["unconverted"]


def logs(seed, keyless):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice(v)
    money = lambda: pick(0, 500, 900, 1000, 1100, 2000)
    n = 0
    notes, events, exercises, adjustments = [], [], [], []
    for issuer in range(12):
        for _ in range(rnd.randint(0, 5)):
            n += 1
            notes.append(dict(issuer=issuer, ord=n, category=pick("CB", "BW", "SO", "전환우선주"), series=rnd.randint(1, 4), kind=pick("a b", "c"), face_value=pick(0, 70_000, 90_000), remaining_balance=pick(None, 0, 50_000), convertible_shares=pick(0, 40, 60), conversion_price=money(), exercise_start=pick("", "2024.01.01"), exercise_end=pick("", "2026.01.01")))
        for _ in range(rnd.randint(0, 7)):
            n += 1
            cat = pick("CB", "BW", "PERPETUAL", "STOCK_OPTION", "RIGHTS_ISSUE", "MIXED_ISSUE")
            events.append(dict(issuer=issuer, ord=n, category=cat, series=rnd.randint(1, 4), kind="", face_value=pick(None, 0, 80_000), conversion_price=pick(None, *[money()]), convertible_shares=pick(None, 0, 33), shares=pick(0, 10, 20), issue_price=pick(None, 700), exercise_price=pick(None, 0, 300), cv_start=pick("", "s1", "s2"), cv_end=pick("", "e1"), rcept_no=pick("", f"r{rnd.randint(1, 3)}"), share_type="", pdf_date=f"d{n}"))
        for _ in range(rnd.randint(0, 8)):
            n += 1
            so = rnd.random() < 0.15
            series = None if keyless and rnd.random() < 0.3 else rnd.randint(1, 6)
            exercises.append(dict(issuer=issuer, entry_date=pick(*DAYS), ord=n, pos=0, type="주식매수선택권행사" if so else pick("신주인수권행사", "전환청구권행사"), exchangeable=rnd.random() < 0.1, series=None if so else series, has_remaining=pick(True, False), remaining=pick(None, 0, 30_000), face_value=pick(None, 60_000), conversion_price=pick(None, 900, 1000), convertible_shares=pick(None, 0, 25), remaining_shares=pick(None, 0, 15), new_shares=pick(0, 77) if so else None))
        for _ in range(rnd.randint(0, 8)):
            n += 1
            series = None if keyless and rnd.random() < 0.5 else rnd.randint(1, 6)
            adjustments.append(dict(issuer=issuer, entry_date=pick(*DAYS), ord=n, part=pick(0, 1), pos=0, series=series, price_before=pick(None, 900, 1000, 1100), price_after=pick(None, 50, 800, 900, 1000), shares_before=pick(None, 0, 40, 33), current_shares=pick(None, 60), shares_after=pick(None, 44), unconverted=pick(None, 0, 45_000)))
    return notes, events, exercises, adjustments


def brute(notes, events, exercises, adjustments):
    out = {}
    for i in range(12):
        b = Book()
        mine = lambda rows: [r for r in rows if r["issuer"] == i]
        for r in mine(notes):
            b.note(r)
        for r in mine(events):
            b.event(r)
        for r in sorted(mine(exercises), key=lambda r: (r["entry_date"], r["ord"])):
            b.exercise(r)
        for r in sorted(mine(adjustments), key=lambda r: (r["entry_date"], r["ord"], r["part"])):
            b.adjust(r)
        out |= {(i, k): tuple(v[f] for f in FIELDS) for k, v in b.rows.items()}
    return out


def frames(spark, data, shuffle=None):
    if shuffle:
        data = [random.Random(shuffle).sample(rows, len(rows)) for rows in data]
    kinds = (schemas.NOTE, schemas.EVENT, schemas.BALANCE, schemas.ADJUSTMENT)

    def frame(rows, schema):
        cols = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)

    return [frame(rows, schema) for rows, schema in zip(data, kinds)]


def result(df):
    return {(r.issuer, r.instrument_key): tuple(r[f] for f in FIELDS) for r in df.collect()}


@pytest.mark.parametrize("seed,keyless", [(1, False), (2, True), (3, True), (4, True)])
def test_fold_equals_plain_reading(spark, seed, keyless):
    data = logs(seed, keyless)
    assert result(fold.fold_instruments(*frames(spark, data))) == brute(*data)


def test_row_order_and_partitions_do_not_matter(spark):
    data = logs(5, True)
    a = result(fold.fold_instruments(*frames(spark, data)))
    b = result(fold.fold_instruments(*[f.repartition(7) for f in frames(spark, data, shuffle=9)]))
    assert a == b == brute(*data)


def test_latest_exercise_wins_over_arrival_order(spark):
    """A later notice that arrives first must not be overwritten by an earlier one."""
    notes = [dict(issuer=1, ord=1, category="CB", series=2, kind="", face_value=15_000_000_000, remaining_balance=None, convertible_shares=1, conversion_price=10_172, exercise_start="", exercise_end="")]
    ex = lambda day, o, left, n: dict(issuer=1, entry_date=datetime.date(2025, 1, day), ord=o, pos=0, type="전환청구권행사", exchangeable=False, series=2, has_remaining=True, remaining=left, face_value=None, conversion_price=None, convertible_shares=n, remaining_shares=None, new_shares=None)
    exercises = [ex(9, 2, 12_273_243_000, 1_206_571), ex(3, 3, 14_000_000_000, 1_376_327)]
    got = result(fold.fold_instruments(*frames(spark, (notes, [], exercises, []))))
    assert got[1, "CB_2"][2] == 12_273_243_000 and got[1, "CB_2"][4] == 1_206_571


def test_price_adjustment_recomputes_shares(spark):
    notes = [dict(issuer=1, ord=i, category="CB", series=i, kind="", face_value=f, remaining_balance=None, convertible_shares=9, conversion_price=12_000, exercise_start="", exercise_end="") for i, f in ((3, 4_000_000_000), (4, 1_000_000_310))]
    adj = [dict(issuer=1, entry_date=DAYS[0], ord=10 + i, part=0, pos=0, series=i, price_before=12_000, price_after=9_714, shares_before=None, current_shares=None, shares_after=None, unconverted=None) for i in (3, 4)]
    got = result(fold.fold_instruments(*frames(spark, (notes, [], [], adj))))
    assert got[1, "CB_3"][4] == 411_776 and got[1, "CB_4"][4] == 102_944


def test_expired_instruments_do_not_dilute(spark):
    from filingframe.operators.aggregates import total_dilutive_shares

    rows = [(1, 100_000, None), (1, 50_000, datetime.date(2030, 1, 1)), (1, 70_000, datetime.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "issuer bigint, convertible_shares bigint, exercise_end date").withColumn("t", F.lit(1_000_000))
    r = total_dilutive_shares(df, as_of=F.lit("2025-01-01").cast("date"), total_shares="t").first()
    assert (r.dilutive_shares, r.dilution_pct) == (150_000, 15.0)


def test_overhang_table_wording(spark):
    row = [(1, "CB_2", (1, 1), "CB", 2, "", 0, 5_000_000_000, 10_000, 500_000, "2023년 9월 28일", "2027-08-28")]
    s = spark.createDataFrame(row, schemas.INSTRUMENT)
    r = state.overhang_table(s, as_of=F.lit("2025-01-01").cast("date"), total_shares=F.lit(12_000_000)).first()
    assert r.category_label == "제2회 전환사채(CB)" and r.remaining_amount == "50 억원 (500,000주)"
    assert (r.exercise_price, r.dilution_ratio, r.exercise_period) == ("10,000원", "4.17%", "2023.09.28~2027.08.28")


def _right(ord_, shares, price=None, receipt="", date="d1", start="", face=None):
    return dict(issuer=1, ord=ord_, category="RIGHTS_ISSUE", series=0, kind="", face_value=face, conversion_price=price, convertible_shares=None, shares=shares, issue_price=None, exercise_price=None, cv_start=start, cv_end="", rcept_no=receipt, share_type="t", pdf_date=date)


@pytest.mark.parametrize("rows", [
    [_right(1, 100, 700, face=5000), _right(2, 200, None, face=9000)],  # another count replaces the date
    [_right(1, 100, 700), _right(2, 200, 800), _right(3, 200, 900, start="s"), _right(4, 300, 50), _right(5, 300, None, start="z")],
    [_right(1, 100, None, date="d2"), _right(2, 100, 650, receipt="r1"), _right(3, 100, 660, date="d3")],
    [_right(1, 100, 5, receipt="r9"), _right(2, 100, 6), _right(3, 400, 7), _right(4, 400, 8, start="q")],
])
def test_rights_without_receipt(spark, rows):
    data = ([], rows, [], [])
    want = brute(*data)
    assert result(fold.fold_instruments(*frames(spark, data))) == want


def test_rights_match_known_instruments(spark):
    """A record without a receipt enriches what an earlier batch has opened."""
    first, second = [_right(1, 100, None, receipt="20240101000001")], [_right(2, 100, 700, date="20240105", start="s")]
    known = state.apply_events(frames(spark, ([], first, [], []))[1])
    got = result(state.apply_events(frames(spark, ([], second, [], []))[1], known))
    assert got == brute([], first + second, [], [])
    assert list(got) == [(1, "RIGHTS_20240101000001")]


def test_kinds_with_an_equal_start_stay_apart(spark):
    note = lambda o, kind: dict(issuer=1, ord=o, category="전환우선주", series=0, kind=kind, face_value=9, remaining_balance=None, convertible_shares=1, conversion_price=1, exercise_start="", exercise_end="")
    notes = [note(1, "x" * 40 + "A"), note(2, "x" * 40 + "B")]
    assert len(result(state.apply_notes(frames(spark, (notes, [], [], []))[0]))) == 2


def test_large_numbers_stay_exact_in_the_fold(spark):
    big = 2**53 + 1
    notes = [dict(issuer=1, ord=1, category="CB", series=1, kind="", face_value=big, remaining_balance=None, convertible_shares=7, conversion_price=1_000, exercise_start="", exercise_end="")]
    adj = [dict(issuer=1, entry_date=DAYS[0], ord=2, part=1, pos=0, series=None, price_before=None, price_after=None, shares_before=7, current_shares=None, shares_after=big, unconverted=None)]
    got = result(fold.fold_instruments(*frames(spark, (notes, [], [], adj))))
    assert got[1, "CB_1"][2] == big and got[1, "CB_1"][4] == big
