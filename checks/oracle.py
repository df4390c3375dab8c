"""SQL for every registered query, written in the two-branch, join-based form.

The library counts both datasets in one aggregate and fences days with a window; the SQL here unions
the filtered and unfiltered rows and joins the fences, so agreement is not by construction.
"""

from __future__ import annotations

KEYS = "city, year, dataset"

CITY = "CASE {key} % 3 WHEN 0 THEN 'Freetown' WHEN 1 THEN 'Kenema' ELSE 'Makeni' END"

TOD = """CASE WHEN hour >= 6 AND hour < 9 THEN '06–08' WHEN hour >= 9 AND hour < 12 THEN '09–11'
    WHEN hour >= 12 AND hour < 15 THEN '12–14' WHEN hour >= 15 AND hour < 18 THEN '15–17'
    ELSE 'Other (Night/Early Morning)' END"""

EVENTS = f"""SELECT event_id, {CITY.format(key="user_id")} AS city,
    CAST(year(ts) AS INTEGER) AS year, user_id AS enumerator, ts AS delivered_ts, CAST(ts AS DATE) AS date, value AS distance,
    CAST(80 AS DOUBLE) AS threshold FROM events"""

UNEVEN = f"""SELECT * REPLACE (CASE WHEN day(date) % 9 = 4 THEN enumerator % 15 ELSE enumerator END
    AS enumerator) FROM ({EVENTS})"""

MISSING = f"""SELECT event_id, city, year, threshold,
    CASE WHEN event_id % 13 <> 0 THEN distance END AS distance,
    CASE WHEN event_id % 17 <> 0 THEN delivered_ts END AS delivered_ts,
    CASE WHEN event_id % 17 <> 0 THEN date END AS date,
    CASE WHEN event_id % 19 <> 0 THEN enumerator END AS enumerator FROM ({UNEVEN})"""

LINEITEM = f"""SELECT {CITY.format(key="l_suppkey")} AS city,
    CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS enumerator,
    CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS distance,
    CAST(40 AS DOUBLE) AS threshold FROM lineitem"""

ORDERS = f"""SELECT {CITY.format(key="o_custkey")} AS city,
    CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS enumerator,
    CAST(o_orderdate AS DATE) AS date, o_totalprice AS distance,
    CAST(400000 AS DOUBLE) AS threshold FROM orders"""

MIXED_TEXT = """CASE WHEN event_id % 8 = 3 THEN 'rejected'
    WHEN event_id % 32 = 2 THEN strftime(ts, '%d/%m/%Y %H:%M:%S WAT')
    WHEN event_id % 16 = 4 THEN strftime(ts, '%d/%m/%Y %I:%M:%S %p')
    WHEN event_id % 16 = 8 THEN strftime(ts, '%d-%b-%Y %H:%M:%S')
    WHEN event_id % 16 = 12 THEN strftime(ts, '%d/%m/%y %H:%M:%S')
    WHEN event_id % 4 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
    WHEN event_id % 16 = 5 THEN strftime(ts, '%m/%d/%Y %H:%M:%S.%g')
    WHEN event_id % 16 = 9 THEN strftime(ts, '%m%d%Y %H%M%S')
    WHEN event_id % 4 = 1 THEN strftime(ts, '%m/%d/%Y %H:%M:%S')
    WHEN event_id % 16 = 6 THEN strftime(ts, '%d/%m/%Y %I:%M ')
        || CASE WHEN hour(ts) < 12 THEN 'a.m.' ELSE 'p.m.' END
    WHEN event_id % 4 = 2 THEN strftime(ts, '%d/%m/%Y %H:%M')
    WHEN event_id % 16 = 7 THEN strftime(ts, '%b %d %Y %H:%M')
    ELSE strftime(ts, '%m/%d/%Y %H:%M') END"""

MULTI_TEXT = """CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0
    THEN event_type || ', annex,' || event_type ELSE event_type END END"""

TEXT = f"""SELECT event_id, user_id, value, ts,
    CASE WHEN event_id % 10 = 7 THEN 'not a date'
        WHEN event_id % 10 = 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        WHEN event_id % 10 = 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02')
        ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS iso_text,
    CASE WHEN event_id % 10 = 7 THEN strftime(ts, '%d.%m %H')
        WHEN event_id % 10 = 5 THEN strftime(ts, '%-m/%-d/%Y %-I:%M %p')
        WHEN event_id % 10 = 1 THEN strftime(ts, '%-m/%-d/%y %-H:%M')
        WHEN event_id % 10 = 9 THEN strftime(ts, '%b %-d %Y %-H:%M')
        ELSE strftime(ts, '%-m/%-d/%Y %-H:%M') END AS mdy_text,
    {MIXED_TEXT} AS mixed_text,
    CASE WHEN event_id % 17 <> 0 THEN {MIXED_TEXT} END AS mixed_or_missing,
    {MULTI_TEXT} AS multi_text FROM events"""


ISO_TIME = """CASE WHEN event_id % 10 = 5 THEN ts - INTERVAL 2 HOUR
    WHEN event_id % 10 <> 7 THEN ts END"""


def _formats(*days: str, clocks: tuple[str, ...]) -> list[str]:
    """Two-digit years first: a four-digit one would be taken for them otherwise."""
    return [f"{day} {clock}" for day in days for clock in clocks]


SECONDS = ("%H:%M:%S", "%I:%M:%S %p", "%H:%M:%S.%g")
MINUTES = ("%H:%M", "%I:%M %p")
DMY, MDY = ("%d/%m/%y", "%d/%m/%Y", "%d-%b-%Y"), ("%m/%d/%y", "%m/%d/%Y", "%b %d %Y")
DMY_HMS = [*_formats(*DMY, clocks=SECONDS), "%d%m%Y %H%M%S"]
MDY_HMS = [*_formats(*MDY, clocks=SECONDS), "%m%d%Y %H%M%S"]
DMY_HM, MDY_HM = _formats(*DMY, clocks=MINUTES), _formats(*MDY, clocks=MINUTES)


def _read(text: str, formats: list[str]) -> str:
    plain = f"replace({text}, '.m.', 'm')"
    return f"date_trunc('second', try_strptime({plain}, {formats!r}))"


def dmy_hms(text: str) -> str:
    return _read(text, DMY_HMS)


def mixed(text: str) -> str:
    return _read(text, DMY_HMS + MDY_HMS + DMY_HM + MDY_HM)


def split(text: str) -> str:
    return f"unnest(coalesce(regexp_split_to_array({text}, ',\\s*'), [NULL]))"


def day_text(date: str = "date") -> str:
    return f"strftime({date}, '%Y-%m-%d') AS date"


def second_text(ts: str = "delivered_ts") -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S') AS delivered_ts"


def _campaigns() -> str:
    """The canonical deliveries of eight campaigns, dealt out by ``user_id % 8``."""
    split_type = split("property_type")
    teams = f"""SELECT event_id, user_id % 8 AS campaign, mixed_or_missing AS delivered_raw,
        'user ' || user_id AS enumerator,
        CASE WHEN event_id % 13 <> 0 THEN value / 1000 END AS distance,
        CASE WHEN user_id % 8 IN (2, 3) THEN {dmy_hms("mixed_or_missing")}
            ELSE {mixed("mixed_or_missing")} END AS delivered_ts,
        multi_text AS property_type FROM ({TEXT})
        WHERE user_id % 8 >= 2 AND mixed_or_missing IS NOT NULL"""
    return f"""SELECT CASE campaign WHEN 0 THEN 'Makeni' WHEN 1 THEN 'Kenema' WHEN 2 THEN 'Kenema'
            ELSE 'Freetown' END AS city,
        CAST(CASE campaign WHEN 0 THEN 2025 WHEN 1 THEN 2025 WHEN 2 THEN 2024
            ELSE 2028 - campaign END AS INTEGER) AS year,
        campaign, enumerator, delivered_raw, delivered_ts, distance, source,
        CAST(CASE WHEN campaign < 2 THEN 80 ELSE 0.08 END AS DOUBLE) AS threshold,
        CAST(property_type AS VARCHAR) AS property_type, CAST(delivered_ts AS DATE) AS date
    FROM (
        SELECT 0 AS campaign, iso_text AS delivered_raw, CAST(user_id AS VARCHAR) AS enumerator,
            value AS distance,
            date_trunc('second', {ISO_TIME}) AS delivered_ts,
            NULL AS property_type, 'iso' AS source FROM ({TEXT}) WHERE user_id % 8 = 0
        UNION ALL
        SELECT 1, mdy_text, CAST(user_id AS VARCHAR), value,
            CASE WHEN event_id % 10 <> 7 THEN date_trunc('minute', ts) END, NULL, 'month_first'
            FROM ({TEXT}) WHERE user_id % 8 = 1
        UNION ALL
        SELECT campaign, delivered_raw, enumerator, distance, delivered_ts, {split_type},
            'teams/campaign=' || campaign || '/team=' || (event_id % 2) FROM ({teams})
    )"""


def _team_file(condition: str, property_type: str) -> str:
    return f"""SELECT mixed_or_missing AS time_delivery_date, 'user ' || user_id AS enteredby,
        CASE WHEN event_id % 13 <> 0 THEN round(value / 1000, 6) END
            AS time_gps_distance_original,
        {property_type} AS property_type FROM ({TEXT}) WHERE {condition}"""


def _with(deliveries: str, select: str) -> str:
    """``select`` over the CTEs counts, daily and trimmed of the deliveries."""
    return f"""WITH deliveries AS ({deliveries}),
    both_sets AS (
        SELECT *, 'Unfiltered' AS dataset FROM deliveries
        UNION ALL SELECT *, 'Filtered' FROM deliveries WHERE distance <= threshold),
    counts AS (SELECT {KEYS}, date, enumerator, count(*) AS enum_daily_deliv FROM both_sets
        GROUP BY {KEYS}, date, enumerator),
    daily AS (SELECT {KEYS}, date, avg(enum_daily_deliv) AS daily_avg FROM counts
        GROUP BY {KEYS}, date),
    fences AS (SELECT {KEYS}, quantile_cont(daily_avg, 0.25) AS Q1,
        quantile_cont(daily_avg, 0.75) AS Q3 FROM daily GROUP BY {KEYS}),
    trimmed AS (SELECT {KEYS}, date, daily_avg, Q1, Q3, Q3 - Q1 AS IQR
        FROM daily JOIN fences USING ({KEYS})
        WHERE daily_avg >= Q1 - 1.5 * (Q3 - Q1) AND daily_avg <= Q3 + 1.5 * (Q3 - Q1))
    {select}"""


COUNTS = f"""SELECT {KEYS}, {day_text()}, CAST(enumerator AS VARCHAR) AS enumerator,
    enum_daily_deliv FROM counts"""

DAILY = f"SELECT {KEYS}, {day_text()}, round(daily_avg, 6) AS daily_avg FROM daily"

TRIMMED = f"""SELECT {KEYS}, {day_text()}, round(daily_avg, 6) AS daily_avg, round(Q1, 6) AS Q1,
    round(Q3, 6) AS Q3, round(IQR, 6) AS IQR FROM trimmed"""

TIMESERIES = f"SELECT {KEYS}, {day_text()}, round(daily_avg, 6) AS daily_avg FROM trimmed"

STATS = f"""SELECT {KEYS}, round(avg(daily_avg), 6) AS mean, round(median(daily_avg), 6) AS median,
    round(stddev_samp(daily_avg), 6) AS sd,
    round(quantile_cont(daily_avg, 0.75) - quantile_cont(daily_avg, 0.25), 6) AS iqr,
    round(quantile_cont(daily_avg, 0.8), 6) AS p80, round(quantile_cont(daily_avg, 0.9), 6) AS p90
    FROM trimmed GROUP BY {KEYS}"""

SUMMARY = f"""SELECT {KEYS}, round(avg(daily_avg), 6) AS mean_daily,
    round(median(daily_avg), 6) AS median_daily, round(quantile_cont(daily_avg, 0.8), 6) AS p80,
    round(quantile_cont(daily_avg, 0.9), 6) AS p90 FROM trimmed GROUP BY {KEYS}"""

COMPARISON = """SELECT city, year, round(u, 6) AS unfiltered_mean, round(f, 6) AS filtered_mean,
    round((u - f) / nullif(u, 0) * 100, 6) AS diff_percent FROM (
        SELECT city, year, avg(daily_avg) FILTER (dataset = 'Unfiltered') AS u,
            avg(daily_avg) FILTER (dataset = 'Filtered') AS f FROM trimmed GROUP BY city, year)"""


def _ends(shared: bool) -> str:
    ends = "min(daily_avg) AS low, max(daily_avg) AS high"
    if shared:
        return f"""(SELECT * FROM (SELECT {KEYS}, count(*) AS n FROM trimmed GROUP BY {KEYS}),
            (SELECT {ends} FROM trimmed))"""
    return f"(SELECT {KEYS}, count(*) AS n, {ends} FROM trimmed GROUP BY {KEYS})"


def _histogram(bins: int, shared: bool = False) -> str:
    in_bin = f"""width = 0 OR bin = CASE WHEN width > 0 THEN least(greatest(
        ceil((daily_avg - low) / width + 0.5 - 1e-8) - 1, 0), {bins - 1}) END"""
    return f"""SELECT {KEYS}, CAST(bin AS INTEGER) AS bin, round(low + (bin - 0.5) * width, 6)
        AS bin_start, round(low + (bin + 0.5) * width, 6) AS bin_end, count,
        round(count / nullif(n * width, 0), 6) AS density
    FROM (
        SELECT {KEYS}, n, low, width, bin, count(*) FILTER ({in_bin}) AS count
        FROM (SELECT *, (high - low) / {bins - 1} AS width,
                unnest(CASE WHEN high > low THEN range(0, {bins}) ELSE [0] END) AS bin
            FROM {_ends(shared)}) AS axis
        JOIN trimmed USING ({KEYS}) GROUP BY {KEYS}, n, low, width, bin
    ) AS filled"""


def _density(shared: bool = False) -> str:
    return f"""SELECT {KEYS}, round(bw, 6) AS bw, CAST(point AS INTEGER) AS point,
        round(any_value(x), 6) AS x,
        round(sum(exp(-0.5 * ((x - daily_avg) / bw) ** 2))
            / (any_value(n) * bw * sqrt(2 * pi())), 6) AS density
    FROM (
        SELECT {KEYS}, n, bw, point, low + point * (high - low) / 511 AS x
        FROM (SELECT {KEYS}, n, low, high, 0.9 * coalesce(nullif(least(sd, iqr / 1.34), 0),
                nullif(sd, 0), nullif(abs(earliest), 0), 1) * n ** (-0.2) AS bw,
                unnest(range(0, 512)) AS point
            FROM {_ends(shared)} AS axis JOIN (
                SELECT {KEYS}, stddev_samp(daily_avg) AS sd,
                    quantile_cont(daily_avg, 0.75) - quantile_cont(daily_avg, 0.25) AS iqr,
                    arg_min(daily_avg, date) AS earliest FROM trimmed GROUP BY {KEYS}
            ) AS spread USING ({KEYS}) WHERE n >= 2)
    ) AS grid JOIN trimmed USING ({KEYS}) GROUP BY {KEYS}, bw, point"""


def _profile(deliveries: str, by: str, name: str) -> str:
    """Average of the counts per date, enumerator and ``by``."""
    return f"""SELECT city, year, {by}, round(avg(enum_deliv), 6) AS {name} FROM (
        SELECT city, year, date, enumerator, {by}, count(*) AS enum_deliv FROM (
            SELECT *, {TOD} AS tod, strftime(date, '%a') AS dow,
                CAST(dayofweek(date) + 1 AS VARCHAR) AS dow_order
            FROM (SELECT *, hour(delivered_ts) AS hour FROM ({deliveries})))
        GROUP BY city, year, date, enumerator, {by}) GROUP BY city, year, {by}"""


def oracle_sql() -> dict[str, str]:
    campaigns = _campaigns()
    split_events = f"""SELECT {CITY.format(key="user_id")} AS city,
        CAST(year(ts) AS INTEGER) AS year, user_id AS enumerator, CAST(ts AS DATE) AS date,
        value AS distance, CAST(80 AS DOUBLE) AS threshold, {split(MULTI_TEXT)} AS property_type
        FROM events"""

    def parsed(expression: str) -> str:
        return f"SELECT event_id, {second_text(expression)} FROM ({TEXT})"

    dow_tod = ("dow, dow_order, tod", "avg_daily_pace_tod_dow")
    in_range = "delivered_ts >= '2024-01-10' AND delivered_ts < '2024-01-21'"

    return {
        "csv_scan": _team_file("true", "multi_text"),
        "multi_file_union": _team_file("event_id % 2 = 0", "multi_text")
        + " UNION ALL "
        + _team_file("event_id % 2 = 1", "NULL"),
        "canonical_deliveries": f"""SELECT city, year, enumerator, delivered_raw, {second_text()},
            round(distance, 6) AS distance, threshold, property_type, source, {day_text()}
            FROM ({campaigns})""",
        "csv_uneven_headers": """SELECT CAST(event_id AS VARCHAR) AS key, 'part=' || event_id % 4 AS source,
            CASE WHEN event_id % 4 < 3 THEN event_type END AS note,
            CASE WHEN event_id % 4 < 2 THEN 'other' END AS note_2,
            CASE WHEN event_id % 4 = 2 THEN 'unnamed' END AS x,
            CASE WHEN event_id % 4 = 3 THEN 'user ' || user_id END AS user FROM events""",
        "campaign_date_range_summary": _with(
            f"SELECT * FROM ({campaigns}) WHERE {in_range}", SUMMARY
        ),
        "campaign_summary": _with(campaigns, SUMMARY),
        "campaign_accuracy_comparison": _with(campaigns, COMPARISON),
        "campaign_bad_dates": f"""SELECT DISTINCT city, year, delivered_raw FROM ({campaigns})
            WHERE campaign >= 2 AND {dmy_hms("delivered_raw")} IS NULL""",
        "campaign_pace_dow_tod": _profile(campaigns, *dow_tod),
        "landed_daily_pace": _with(UNEVEN, DAILY),
        "accuracy_filter": f"""SELECT event_id, city, year,
            CAST(enumerator AS VARCHAR) AS enumerator, {second_text()}, {day_text()}, round(distance, 6) AS distance, threshold
            FROM ({MISSING}) WHERE distance <= threshold""",
        "missing_date_filter": f"""SELECT event_id, mixed_or_missing FROM ({TEXT})
            WHERE mixed_or_missing IS NOT NULL""",
        "split_multivalue": f"""SELECT event_id, {split("multi_text")} AS property_type
            FROM ({TEXT})""",
        "parse_iso": parsed(ISO_TIME),
        "parse_mdy_hm": parsed(_read("mdy_text", MDY_HM)),
        "parse_dmy_hms": parsed(dmy_hms("mixed_text")),
        "parse_mixed_formats": parsed(mixed("mixed_text")),
        "parse_mixed_date_range": f"""SELECT event_id, {second_text()} FROM (
            SELECT event_id, {mixed("mixed_text")} AS delivered_ts FROM ({TEXT})) WHERE {in_range}""",
        "bad_dates": f"""SELECT DISTINCT mixed_or_missing FROM ({TEXT})
            WHERE mixed_or_missing IS NOT NULL AND {dmy_hms("mixed_or_missing")} IS NULL""",
        "time_features": f"""SELECT event_id, {second_text()}, {day_text("delivered_ts")},
            strftime(delivered_ts, '%a') AS dow,
            CAST(dayofweek(delivered_ts) + 1 AS VARCHAR) AS dow_order,
            CAST(hour AS VARCHAR) AS hour, {TOD} AS tod
            FROM (SELECT *, hour(delivered_ts) AS hour FROM ({MISSING}))""",
        "enumerator_daily_counts": _with(MISSING, COUNTS),
        "daily_pace": _with(MISSING, DAILY),
        "split_daily_pace": _with(split_events, DAILY),
        "iqr_trim": _with(LINEITEM, TRIMMED),
        "all_daily_pace": _with(UNEVEN, TRIMMED),
        "all_daily_pace_with_missing": _with(MISSING, TRIMMED),
        "all_daily_pace_orders": _with(ORDERS, TRIMMED),
        "pace_stats": _with(UNEVEN, STATS),
        "pace_stats_lineitem": _with(LINEITEM, STATS),
        "pace_stats_orders": _with(ORDERS, STATS),
        "summary_all": _with(UNEVEN, SUMMARY),
        "summary_all_lineitem": _with(LINEITEM, SUMMARY),
        "accuracy_comparison": _with(UNEVEN, COMPARISON),
        "accuracy_comparison_lineitem": _with(LINEITEM, COMPARISON),
        "pace_by_tod": _profile(MISSING, "tod", "avg_daily_pace_tod"),
        "pace_by_dow": _profile(MISSING, "dow, dow_order", "avg_daily_pace_dow"),
        "pace_by_dow_tod": _profile(MISSING, *dow_tod),
        "all_pace_dow_tod": _profile(EVENTS, *dow_tod),
        "pace_trend_by_tod": _profile(UNEVEN, *dow_tod),
        "pace_timeseries": _with(UNEVEN, TIMESERIES),
        "pace_histogram": _with(UNEVEN, _histogram(15)),
        "pace_histogram_lineitem": _with(LINEITEM, _histogram(15)),
        "pace_histogram_orders": _with(ORDERS, _histogram(15)),
        "pace_histogram_faceted": _with(UNEVEN, _histogram(20, shared=True)),
        "pace_histogram_faceted_lineitem": _with(LINEITEM, _histogram(20, shared=True)),
        "pace_density": _with(UNEVEN, _density()),
        "pace_density_orders": _with(ORDERS, _density()),
        "pace_density_faceted": _with(UNEVEN, _density(shared=True)),
        "report_pace_stats": _with(UNEVEN, STATS),
        "report_summary_all": _with(UNEVEN, SUMMARY),
        "report_accuracy_comparison": _with(UNEVEN, COMPARISON),
        "report_pace_by_tod": _profile(UNEVEN, "tod", "avg_daily_pace_tod"),
        "report_pace_by_dow": _profile(UNEVEN, "dow, dow_order", "avg_daily_pace_dow"),
        "report_pace_by_dow_tod": _profile(UNEVEN, *dow_tod),
        "report_pace_trend_by_tod": _profile(UNEVEN, *dow_tod),
        "report_pace_timeseries": _with(UNEVEN, TIMESERIES),
        "report_pace_histogram": _with(UNEVEN, _histogram(15)),
        "report_pace_density": _with(UNEVEN, _density()),
        "report_pace_histogram_shared": _with(UNEVEN, _histogram(20, shared=True)),
        "report_pace_density_shared": _with(UNEVEN, _density(shared=True)),
    }
