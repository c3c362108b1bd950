"""Tables of the dilution state.

``inserted`` is the position at which an instrument entered the state: (phase, ord). Keyless
records pick the first instrument in that order.
"""

INSTRUMENT = (
    "issuer bigint, instrument_key string, inserted struct<phase:int,ord:bigint>, category string,"
    " series bigint, kind string, face_value bigint, remaining bigint, conversion_price bigint,"
    " convertible_shares bigint, exercise_start string, exercise_end string"
)
FIELDS = [
    "category", "series", "kind", "face_value", "remaining", "conversion_price", "convertible_shares",
    "exercise_start", "exercise_end",
]
NOTE = (
    "issuer bigint, ord bigint, category string, series bigint, kind string, face_value bigint,"
    " remaining_balance bigint, convertible_shares bigint, conversion_price bigint,"
    " exercise_start string, exercise_end string"
)
EVENT = (
    "issuer bigint, ord bigint, category string, series bigint, kind string, face_value bigint,"
    " conversion_price bigint, convertible_shares bigint, shares bigint, issue_price bigint,"
    " exercise_price bigint, cv_start string, cv_end string, rcept_no string, share_type string,"
    " pdf_date string"
)
BALANCE = (
    "issuer bigint, entry_date date, ord bigint, pos bigint, type string, exchangeable boolean,"
    " series bigint, has_remaining boolean, remaining bigint, face_value bigint, conversion_price bigint,"
    " convertible_shares bigint, remaining_shares bigint, new_shares bigint"
)
ADJUSTMENT = (
    "issuer bigint, entry_date date, ord bigint, part int, pos bigint, series bigint, price_before bigint,"
    " price_after bigint, shares_before bigint, current_shares bigint, shares_after bigint, unconverted bigint"
)

# --- fixed values: categories and labels of the state ------------------------------------------
OPTION_EXERCISE = "주식매수선택권행사"
OPTION_CATEGORIES = ("주식매수선택권", "SO")
EVENT_CATEGORY = {"CB": "CB", "BW": "BW", "PERPETUAL": "영구채"}
RIGHTS_CATEGORY = "전환우선주"
OPTION_CATEGORY = "주식매수선택권"
MIN_PRICE = 100  # a conversion price below par is a parsing error
