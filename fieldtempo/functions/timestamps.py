"""Delivery timestamps: text to wall-clock time (``TIMESTAMP_NTZ``, UTC).

``TIMESTAMP_NTZ`` makes every result independent of the session time zone. Dates are read from the
runs of digits in the text, so any separators do. Fields are range-checked before a timestamp is
built: a failed format costs a comparison, not an exception per row.

The result leaves each reader through a generator of one row. Spark would otherwise push a filter on
the result, say a range of dates, through the steps of the reader and repeat them inside the filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The formats tried for mixed text, first match wins.
MIXED_ORDERS = ("dmy HMS", "mdy HMS", "dmy HM", "mdy HM")

# Two-digit years up to this one are 20xx, later ones 19xx.
LAST_2000S_YEAR = 68

# Month names as they may be written: the first letters, or all.
MONTHS = (
    "JAN(?:UARY)?",
    "FEB(?:RUARY)?",
    "MAR(?:CH)?",
    "APR(?:IL)?",
    "MAY",
    "JUNE?",
    "JULY?",
    "AUG(?:UST)?",
    "SEPT?(?:EMBER)?",
    "OCT(?:OBER)?",
    "NOV(?:EMBER)?",
    "DEC(?:EMBER)?",
)

# Where letters may stand: a T between date and clock, and behind the clock a half of the day, dotted
# or not, and a name of UTC.
KNOWN_LETTERS = (
    "^[^A-Z]*((?<=[0-9])T(?=[0-9])[^A-Z]*)?(?<=[0-9])[^0-9A-Z]*"
    "([AP][^0-9A-Z]?M[^0-9A-Z]*)?(Z|UTC|GMT)?[^0-9A-Z]*$"
)
HALF = "([AP])[^0-9A-Z]?M[^0-9]*$"

# The eight digits of a date and the four or six of a time, without separators in them.
COMPACT = r"^\D*(\d\d)(\d\d)(\d{4})\D*(\d\d)(\d\d)(\d\d)?\D*$"

# Sign and hours of a UTC offset, with or without minutes.
OFFSET = r"[+-]\d{2}(?::?\d{2})?"


def _within(number: str, low: int, high: int) -> str:
    return f"({number} >= {low} AND {number} <= {high})"


def _offset_minutes(offset: str) -> str:
    return f"""(CAST(substring({offset}, 2, 2) AS int) * 60
        + IF(length({offset}) > 3, CAST(right({offset}, 2) AS int), 0))
        * IF({offset} LIKE '-%', -1, 1)"""


def _through_steps(
    df: DataFrame, steps: Sequence[dict[str, str]], result: str, into: str
) -> DataFrame:
    """Add ``into``; each step is columns of its own, so that each is computed once per row."""
    columns = [f"`{name}`" for name in df.columns if name != into]
    for step in steps:
        df = df.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return df.selectExpr(*columns, f"inline_outer(array(named_struct('{into}', {result})))")


def parse_delivered(df: DataFrame, text: str, into: str, orders: Sequence[str]) -> DataFrame:
    """Add ``into``: the wall-clock time of ``text`` under the first order that fits, else NULL.

    An order names the date parts as they appear, the year last, and then the clock parts, e.g.
    ``dmy HMS``; a fraction of a second is dropped. The month may be a name in its place, and the
    digits of a date with a four-digit year may stand without separators. ``AM`` and ``PM``, dotted
    or not, need an hour from 1 to 12; a UTC offset is applied. Text with letters that are none of
    these is NULL. Each row is read on its own: the other rows of the table never change the result.
    """

    def fits(order: str) -> str:
        # A day that its month lacks also rules out the swapped reading, so ranges are enough to
        # choose an order.
        month = order.index("m")
        count = len(order.replace(" ", ""))
        return f"_count = {count} AND _named IN (0, {month + 1}) AND _month{month} AND _day{1 - month}"

    # Where the month stands, under the first order that fits: first or second, and the day beside it.
    month_at = " ".join(f"WHEN {fits(order)} THEN {order.index('m')}" for order in orders)

    any_month = f"(?<![A-Z])(?:{'|'.join(MONTHS)})(?![A-Z])"
    abbreviations = "".join(name[:3] for name in MONTHS)
    month_number = f"(locate(left(_name, 3), '{abbreviations}') + 2) div 3"
    # Digits without separators: day, month and year in eight, then the clock in four or six.
    separated = rf"rtrim(regexp_replace(_plain, r'{COMPACT}', '$1 $2 $3 $4 $5 $6'))"
    runs = rf"""IF(length(get(_tokens, 0)) IN (8, 12, 14) AND _name = '' AND _plain RLIKE r'{COMPACT}',
        split({separated}, ' '), _tokens)"""
    # The place of a month's name among the numbers; a name that stands twice has none.
    named = """CASE WHEN _name = '' THEN 0
        WHEN length(_body) - length(replace(_body, _name, '')) = length(_name)
        THEN size(split(substring_index(_body, _name, 1), '[0-9]+')) ELSE -1 END"""

    year = f"""CASE length(get(_runs, 2)) WHEN 4 THEN _n2
        WHEN 2 THEN _n2 + IF(_n2 <= {LAST_2000S_YEAR}, 2000, 1900) END"""
    hour = f"""CASE WHEN _half = '' THEN _n3
        WHEN {_within("_n3", 1, 12)} THEN _n3 % 12 + IF(_half = 'P', 12, 0) END"""
    # Most texts have no sign behind the date and no letters, and need none of the patterns for them.
    behind = "substring(_text, 9)"
    offset = rf"""CASE WHEN (contains({behind}, '+') OR contains({behind}, '-'))
            AND _text RLIKE r':\d+([.]\d+)?\s*{OFFSET}$'
        THEN regexp_extract(_text, r'{OFFSET}$', 0) END"""
    fraction = r"size(_runs) = 7 AND _body RLIKE r':\d+[.]\d+\D*$'"
    in_range = " AND ".join(
        ["_at >= 0", "_known", _within("_hour", 0, 23)]
        + [_within("_n4", 0, 59), _within("_n5", 0, 59)]
    )
    time = """try_make_timestamp_ntz(
        _year, IF(_at = 0, _n0, _n1), IF(_at = 0, _n1, _n0), _hour, _n4, _n5)"""
    moved = f"""IF(_offset IS NULL, _time,
        timestampadd(MINUTE, -({_offset_minutes("_offset")}), _time))"""
    steps = [
        {"_text": f"upper(trim(`{text}`))"},
        {"_offset": offset},
        {"_body": "IF(_offset IS NULL, _text, left(_text, length(_text) - length(_offset)))"},
        {"_lettered": "_body <> lower(_body)"},
        {"_name": f"IF(_lettered, regexp_extract(_body, r'{any_month}', 0), '')"},
        {
            "_plain": f"""IF(_name = '', _body,
                replace(_body, _name, concat(' ', {month_number}, ' ')))"""
        },
        {
            "_known": f"NOT _lettered OR _plain RLIKE '{KNOWN_LETTERS}'",
            "_half": f"IF(_lettered, regexp_extract(_plain, '{HALF}', 1), '')",
        },
        {"_tokens": "regexp_extract_all(_plain, '[0-9]+', 0)"},
        {"_runs": runs, "_named": named},
        {
            "_numbers": "try_cast(_runs AS array<int>)",
            "_count": f"IF({fraction}, 6, size(_runs))",
        },
        {
            # No number is -1, which is in no range; seconds may be left out.
            **{f"_n{n}": f"coalesce(get(_numbers, {n}), -1)" for n in range(5)},
            "_n5": "IF(_count = 5, 0, coalesce(get(_numbers, 5), -1))",
        },
        {f"_{part}{n}": _within(f"_n{n}", 1, most) for part, most in (("month", 12), ("day", 31)) for n in (0, 1)},
        {"_at": f"CASE {month_at} ELSE -1 END", "_year": year, "_hour": hour},
        {"_time": f"CASE WHEN {in_range} THEN {time} END"},
    ]
    return _through_steps(df, steps, moved, into)


def parse_dmy_hms(df: DataFrame, text: str, into: str) -> DataFrame:
    return parse_delivered(df, text, into, ["dmy HMS"])


def parse_mdy_hm(df: DataFrame, text: str, into: str) -> DataFrame:
    return parse_delivered(df, text, into, ["mdy HM"])


def parse_mixed(df: DataFrame, text: str, into: str) -> DataFrame:
    """Day-first wins wherever both readings are valid dates."""
    return parse_delivered(df, text, into, MIXED_ORDERS)


def parse_iso(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``: the time of ISO text; a UTC offset, if any, is applied.

    Text without a full date is NULL.
    """
    day, clock = r"\d{4}-\d{1,2}-\d{1,2}", "[T ][0-9:.]+"
    iso = rf"^{day}({clock})?\s*(Z|{OFFSET})?$"
    # A sign after the date can only be that of an offset; most texts have none to look for.
    after_date = "substring(_text, 9)"
    steps = [
        {"_text": f"trim(`{text}`)"},
        {
            "_offset": rf"""CASE WHEN {after_date} LIKE '%+%' OR {after_date} LIKE '%-%'
                THEN nullif(regexp_extract(_text, r'[0-9]\s*({OFFSET})$', 1), '') END"""
        },
        {
            "_local": f"""CASE WHEN _text RLIKE r'{iso}' THEN try_cast(rtrim(
                IF(_offset IS NULL, _text, left(_text, length(_text) - length(_offset))))
                AS timestamp_ntz) END""",
        },
    ]
    moved = f"""IF(_offset IS NULL, _local,
        timestampadd(MINUTE, -({_offset_minutes("_offset")}), _local))"""
    return _through_steps(df, steps, moved, into)
