"""SQL twins of the registered queries, for another engine.

Each statement derives the fleet inputs from the raw tables in common table
expressions and computes the result by plain SQL.  The idle history is built
differently from the Spark side on purpose: a unit x month grid joined to all
leases started by then, instead of running sums over lease months.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2001-11-15 12:00:00'"
TODAY = "DATE '2001-11-15'"
YEAR = 2001
BRANCH = "Branch 3"

_RARE = (
    "'CHASSIS', 'CONGEAR', 'CURTAIN', 'DROPDECK', 'ELECTRIC STANDBY UNIT', 'REEFER ELECTRIC STANDBY UNIT', "
    "'SEE COMMENTS', 'MOVE VAN', 'STEPDECK', 'PUP', 'PUP VAN'"
)


def _type(column: str = "Type", rare: bool = True) -> str:
    extra = f" OR trim({column}) IN ({_RARE})" if rare else ""
    return (
        f"CASE WHEN {column} IS NULL OR trim({column}) = ''{extra} THEN 'SPECIALTY' "
        f"WHEN trim({column}) IN ('VAN', 'DRY VAN') THEN 'DRY_VAN' "
        f"WHEN trim({column}) IN ('VAN LIFTGATE', 'LIFTGATE') THEN 'DRY_VAN_LIFTGATE' "
        f"WHEN trim({column}) = 'REEFER LIFTGATE' THEN 'REEFER_LIFTGATE' ELSE trim({column}) END"
    )


_AGE = f"({YEAR} - TRY_CAST(Year AS INTEGER))"
_USAGE = (
    f"CASE WHEN {_AGE} BETWEEN 0 AND 3 THEN 'OTR_0' WHEN {_AGE} BETWEEN 4 AND 6 THEN 'OTR_1' "
    f"WHEN {_AGE} BETWEEN 7 AND 8 THEN 'OTR_2' WHEN {_AGE} BETWEEN 9 AND 12 THEN 'CART_1' "
    f"WHEN {_AGE} BETWEEN 13 AND 16 THEN 'CART_2' ELSE 'STORAGE' END"
)
_YEARS = (
    f"CASE WHEN {_AGE} < 0 THEN 'After 2001' WHEN {_AGE} > 16 THEN 'Before 1985' "
    f"WHEN {_AGE} <= 3 THEN '1998-2001' WHEN {_AGE} <= 6 THEN '1995-1997' WHEN {_AGE} <= 8 THEN '1993-1994' "
    f"WHEN {_AGE} <= 12 THEN '1989-1992' WHEN {_AGE} <= 16 THEN '1985-1988' END"
)
_FEET = "CASE WHEN replace(Length, '''', '') = '' THEN 0 ELSE TRY_CAST(replace(Length, '''', '') AS INTEGER) END"
_LENGTH = (
    f"CASE WHEN {_FEET} < 28 THEN '20' WHEN {_FEET} BETWEEN 28 AND 32 THEN '28-32' "
    f"WHEN {_FEET} BETWEEN 33 AND 42 THEN '40' WHEN {_FEET} BETWEEN 43 AND 50 THEN '48' ELSE '53' END"
)
_IDLE_BUCKET = (
    "CASE WHEN MonthsIdle < 6 THEN '0-6 Months' WHEN MonthsIdle < 12 THEN '6-12 Months' "
    "WHEN MonthsIdle < 24 THEN '12-24 Months' ELSE '24+ Months' END"
)


def _cents(amount: str, floor: int, span: int) -> str:
    return (
        f"cast(cast({floor} + cast(round({amount} * 100, 0) AS bigint) % {span} AS decimal(18,0)) * 0.01 AS decimal(18,2))"
    )


def _n(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def _mean(column: str) -> str:
    """Mean of a decimal column to six places."""
    return f"round(CAST(sum({column}) AS DOUBLE) / count({column}), 6)"


def _ratio(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / NULLIF({whole}, 0)"


# Common table expressions in dependency order.
_CTES = {
    "trailers": """
SELECT 'U' || lpad(cast(p_partkey AS string), 7, '0') AS Unit,
  CASE WHEN p_partkey % 10 <= 5 THEN 'LEASED' WHEN p_partkey % 10 <= 8 THEN 'AVAILABLE' ELSE 'BOS' END AS Status,
  CASE p_brand WHEN 'Brand#23' THEN 'TBD' WHEN 'Brand#24' THEN NULL WHEN 'Brand#25' THEN ''
    ELSE 'Branch ' || substr(p_brand, 7) END AS Fleetcity,
  CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_partkey % 3 = 0 THEN ' DRY VAN ' ELSE 'VAN' END
       WHEN p_type = 'SMALL' THEN CASE WHEN p_partkey % 3 = 0 THEN 'VAN LIFTGATE' ELSE 'LIFTGATE' END
       WHEN p_type = 'MEDIUM' THEN 'REEFER' WHEN p_type = 'PROMO' THEN 'REEFER LIFTGATE'
       WHEN p_type = 'STANDARD' THEN 'FLATBED'
       ELSE CASE p_partkey % 4 WHEN 0 THEN 'CHASSIS' WHEN 1 THEN 'PUP' WHEN 2 THEN ' ' ELSE NULL END END AS Type,
  CASE WHEN p_partkey % 97 = 0 THEN 'N/A' ELSE cast(2002 - p_size % 20 AS string) END AS Year,
  CASE WHEN p_partkey % 101 = 0 THEN NULL WHEN p_partkey % 103 = 0 THEN ''
       ELSE CASE p_partkey % 7 WHEN 0 THEN '20' WHEN 1 THEN '28''' WHEN 2 THEN '40' WHEN 3 THEN '48'''
         WHEN 4 THEN '45' ELSE '53''' END END AS Length,
  p_brand AS Make, 'VIN' || lpad(cast(p_partkey * 7919 AS string), 14, '0') AS VIN,
  cast(round(p_retailprice * 20, 2) AS decimal(18,2)) AS Cost,
  DATE '1994-01-01' + cast(p_partkey % 365 AS int) AS PurchaseDate,
  CASE WHEN p_partkey % 10 = 9 THEN DATE '2000-01-01' + cast(p_partkey % 365 AS int) END AS SoldDate
FROM part""",
    "leases": f"""
SELECT o_orderkey AS LeaseID,
  'U' || lpad(cast(o_orderkey % n - CASE WHEN (o_orderkey % n) % 20 = 6 THEN 1 ELSE 0 END AS string), 7, '0') AS Unit, o_custkey AS CustomerID,
  CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS LeaseStatus,
  cast(o_orderdate AS date) AS DateOn,
  CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 = 0 THEN NULL
       WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) + 90
       WHEN o_orderstatus = 'O' THEN cast(o_orderdate AS date) + cast(30 + o_custkey % 300 AS int)
       ELSE cast(o_orderdate AS date) + 180 END AS DateOff,
  {_cents('o_totalprice', 30000, 150000)} AS Rate
FROM orders CROSS JOIN (SELECT count(*) AS n FROM part) c""",
    "invoice_lines": f"""
SELECT 'INV' || cast(l_orderkey AS string) AS InvoiceNo, l_orderkey AS LeaseNumber,
  'U' || lpad(cast(l_partkey AS string), 7, '0') AS UnitNumber,
  cast(l_shipdate AS date) - 29 AS BillingStartDate, cast(l_shipdate AS date) AS BillingStopDate,
  {_cents('l_extendedprice', 30000, 150000)} AS BilledMonthlyRate,
  {_cents('l_extendedprice', 1000, 5000)} AS BilledDailyRate,
  cast(l_tax AS decimal(18,4)) AS BilledMileageRate,
  CASE l_returnflag WHEN 'A' THEN 'LEASE' WHEN 'N' THEN 'MILEAGE' ELSE 'REPAIR' END AS LineKind
FROM lineitem""",
    "invoice_headers": """
SELECT 'INV' || cast(o_orderkey AS string) AS InvoiceNo, o_custkey AS CustomerID, cast(o_orderdate AS date) AS InvoiceDate
FROM orders""",
    "invoices": """
SELECT h.InvoiceNo, h.CustomerID, h.InvoiceDate,
  CASE WHEN o % 60 <> 5 THEN cast(coalesce(b.billed, 0) + CASE WHEN o % 40 = 3 THEN 1 ELSE 0 END AS decimal(18,2)) END AS InvoiceTotal
FROM (SELECT *, cast(substr(InvoiceNo, 4) AS bigint) AS o FROM invoice_headers) h
LEFT JOIN (SELECT InvoiceNo, sum(BilledMonthlyRate) AS billed FROM invoice_lines GROUP BY InvoiceNo) b ON h.InvoiceNo = b.InvoiceNo
WHERE o % 50 <> 7""",
    "reconciled": """
SELECT coalesce(h.InvoiceNo, l.InvoiceNo) AS invoice_no, h.CustomerID AS customer_id, h.InvoiceDate AS invoice_date,
  h.InvoiceTotal AS stated_total, coalesce(l.n, 0) AS line_count, l.total AS line_total, l.total - h.InvoiceTotal AS difference,
  CASE WHEN h.InvoiceNo IS NULL THEN 'no header' WHEN l.n IS NULL THEN 'no lines' WHEN h.InvoiceTotal IS NULL THEN 'no total'
       WHEN l.total = h.InvoiceTotal THEN 'agrees' ELSE 'differs' END AS status
FROM invoices h FULL JOIN (SELECT InvoiceNo, count(*) AS n, sum(BilledMonthlyRate) AS total FROM invoice_lines GROUP BY InvoiceNo) l
  ON h.InvoiceNo = l.InvoiceNo""",
    "asset_statuses": """
SELECT AssetName, LastUpdate, Speed, Heading, Latitude, Longitude, Address, City, State FROM (
  SELECT 'U' || lpad(cast(event_id % n AS string), 7, '0') AS AssetName, ts - INTERVAL 8112 DAY AS LastUpdate,
    value % 70 AS Speed, cast(user_id % 360 AS int) AS Heading,
    CASE WHEN event_type = 'error' THEN NULL ELSE 25 + value % 24 END AS Latitude,
    CASE WHEN event_type = 'error' THEN NULL ELSE -124 + value % 57 END AS Longitude,
    cast(user_id AS string) || ' Main St, Unit ' || event_type AS Address,
    'City ' || cast(user_id % 40 AS string) AS City,
    CASE WHEN event_type = 'signup' THEN NULL ELSE 'S' || lpad(cast(user_id % 20 AS string), 2, '0') END AS State,
    row_number() OVER (PARTITION BY event_id % n ORDER BY ts DESC, event_id DESC) AS rn
  FROM events CROSS JOIN (SELECT count(*) AS n FROM part) c) p WHERE rn = 1""",
    "card_rates": """
SELECT t.type_bucket, u.usage_category, l.length_bucket,
  CASE WHEN t.type_bucket = 'SPECIALTY' AND u.usage_category = 'STORAGE' THEN cast(0 AS decimal(18,2))
       ELSE cast(t.base + u.adj + l.adj AS decimal(18,2)) END AS CardRateMonth
FROM (VALUES ('DRY_VAN', 900), ('DRY_VAN_LIFTGATE', 1000), ('REEFER', 1300), ('REEFER_LIFTGATE', 1400),
  ('SPECIALTY', 700)) t(type_bucket, base)
CROSS JOIN (VALUES ('OTR_0', 200), ('OTR_1', 150), ('OTR_2', 100), ('CART_1', 50), ('CART_2', 0), ('STORAGE', -100))
  u(usage_category, adj)
CROSS JOIN (VALUES ('20', -100), ('28-32', -50), ('40', 0), ('48', 50), ('53', 100)) l(length_bucket, adj)""",
    "enriched": f"""
SELECT *, {_type()} AS type_bucket, {_USAGE} AS usage_category, {_LENGTH} AS length_bucket, {_YEARS} AS year_range
FROM trailers""",
    "rated": """
SELECT e.*, r.CardRateMonth FROM enriched e LEFT JOIN card_rates r ON e.type_bucket = r.type_bucket
  AND e.usage_category = r.usage_category AND e.length_bucket = r.length_bucket""",
    "fleet": "SELECT * FROM enriched WHERE Status IN ('AVAILABLE', 'LEASED') AND Fleetcity <> 'TBD'",
    "named": """
SELECT * FROM enriched WHERE Status IN ('AVAILABLE', 'LEASED')
  AND Fleetcity IS NOT NULL AND Fleetcity <> '' AND Fleetcity <> 'TBD'""",
    "revenue": """
SELECT i.UnitNumber, r.Fleetcity AS Branch, r.type_bucket AS TypeBucket, r.usage_category AS UsageCategory,
  r.length_bucket AS LengthBucket, r.year_range AS YearRange, i.BillingStartDate, i.BillingStopDate,
  i.BilledMonthlyRate, i.BilledDailyRate, i.BilledMileageRate, r.CardRateMonth,
  i.BilledMonthlyRate - r.CardRateMonth AS MonthlyRateVariance,
  CASE WHEN r.CardRateMonth > 0 THEN CAST(i.BilledMonthlyRate - r.CardRateMonth AS DOUBLE)
    / CAST(NULLIF(r.CardRateMonth, 0) AS DOUBLE) END AS Pct,
  i.InvoiceNo, i.LeaseNumber, i.LineKind
FROM invoice_lines i LEFT JOIN rated r ON i.UnitNumber = r.Unit""",
    "priced": "SELECT * FROM revenue WHERE CardRateMonth IS NOT NULL AND Branch <> 'TBD'",
    "days": f"""
SELECT least(last_day(CAST(m AS DATE)), {TODAY}) AS d
FROM generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2001-11-01', INTERVAL 1 MONTH) g(m)""",
    "grid": """
SELECT t.Unit, t.PurchaseDate, t.Fleetcity, days.d FROM trailers t CROSS JOIN days
WHERE t.PurchaseDate <= days.d AND (t.SoldDate IS NULL OR t.SoldDate > days.d)""",
    "unit_months": """
SELECT g.Unit, g.d, g.PurchaseDate, g.Fleetcity, count(l.LeaseID) AS leases,
  max(CASE WHEN l.DateOff <= g.d THEN l.DateOff END) AS last_off,
  coalesce(bool_or(l.LeaseID IS NOT NULL AND (l.DateOff IS NULL OR l.DateOff > g.d)), FALSE) AS rented
FROM grid g LEFT JOIN leases l ON l.Unit = g.Unit AND l.DateOn <= g.d
GROUP BY g.Unit, g.d, g.PurchaseDate, g.Fleetcity""",
    "idle_all": f"""
SELECT *, {_IDLE_BUCKET} AS IdleDurationBucket FROM (
  SELECT strftime(m.d, '%Y-%m') AS MonthStr, m.Unit, r.Fleetcity AS Branch, r.type_bucket AS TypeBucket,
    r.usage_category AS UsageCategory, r.length_bucket AS LengthBucket, r.year_range AS YearRange,
    r.Cost AS AssetCost, strftime(m.last_off, '%Y-%m') AS LastActiveMonth, m.leases AS CumulativeLeases,
    date_diff('month', coalesce(m.last_off, m.PurchaseDate), m.d) AS MonthsIdle, r.CardRateMonth AS CardRate
  FROM unit_months m JOIN rated r ON m.Unit = r.Unit WHERE NOT m.rented) x""",
    "latest": "SELECT * FROM idle_all WHERE MonthStr = (SELECT max(MonthStr) FROM idle_all)",
    "misspelt": """
SELECT * REPLACE (CASE cast(substr(Unit, 2) AS bigint) % 3 WHEN 0 THEN upper(Fleetcity) WHEN 1 THEN Fleetcity || '  ' ELSE Fleetcity END AS Fleetcity)
FROM trailers""",
    "one_spelling": """
SELECT m.* REPLACE (s.spelled AS Fleetcity) FROM misspelt m
LEFT JOIN (SELECT lower(rtrim(Fleetcity)) AS key, min(Fleetcity) AS spelled FROM misspelt WHERE Fleetcity IS NOT NULL GROUP BY 1) s
  ON lower(rtrim(m.Fleetcity)) = s.key""",
    "idle": "SELECT * FROM latest WHERE Branch <> 'TBD'",
    "statistics": """
SELECT strftime(d, '%Y-%m') AS Month, 'GLOBAL' AS AggLevel, 'ALL' AS Branch, count(*) AS NumTrailers,
  CAST(sum(CASE WHEN rented THEN 1 ELSE 0 END) AS BIGINT) AS NumRentedTrailers FROM unit_months GROUP BY d
UNION ALL
SELECT strftime(d, '%Y-%m'), 'BY_BRANCH', Fleetcity, count(*),
  CAST(sum(CASE WHEN rented THEN 1 ELSE 0 END) AS BIGINT) FROM unit_months GROUP BY d, Fleetcity""",
    "positions": """
SELECT s.*, l.CustomerID, g.LastUpdate, g.Speed, g.Heading, g.Latitude, g.Longitude, g.Address, g.City, g.State
FROM trailers s JOIN leases l ON s.Unit = l.Unit AND l.LeaseStatus = 'ACTIVE'
LEFT JOIN asset_statuses g ON s.Unit = g.AssetName WHERE s.Status = 'LEASED'""",
    "located": f"""
SELECT s.*, l.CustomerID, g.LastUpdate, g.Speed, g.Heading, g.Latitude, g.Longitude, g.Address, g.City, g.State
FROM trailers s JOIN leases l ON s.Unit = l.Unit AND l.LeaseStatus = 'ACTIVE' AND l.DateOn <= {AS_OF}
  AND (l.DateOff IS NULL OR l.DateOff > {AS_OF})
LEFT JOIN asset_statuses g ON s.Unit = g.AssetName
WHERE s.Status = 'LEASED' AND g.Latitude IS NOT NULL AND g.Longitude IS NOT NULL""",
    "unpriced": """
SELECT UnitNumber, Branch, TypeBucket, UsageCategory, LengthBucket, YearRange, BilledMonthlyRate
FROM revenue WHERE CardRateMonth IS NULL AND Branch <> 'TBD'""",
}

_LEASED = _n("Status = 'LEASED'")
_AVAILABLE = _n("Status = 'AVAILABLE'")
_FLEET_RATIO = _ratio(_LEASED, "count(*)")
_COUNTS = f"count(*) AS total_trailers, {_LEASED} AS leased_trailers"
_CRITICAL = _n("IdleDurationBucket = '24+ Months'")
_NEVER = _n("CumulativeLeases = 0")
_COST = "coalesce(sum(AssetCost), 0) AS total_cost"
_MONTHS = "coalesce(avg(MonthsIdle), 0) AS avg_months_idle"
_LOST = "coalesce(sum(CardRate), 0) AS monthly_opportunity_cost"
_IDLE_MEASURES = f"count(*) AS unit_count, {_COST}, {_MONTHS}, {_LOST}"
_RATES = (
    f"count(*) AS invoice_count, sum(BilledMonthlyRate) AS total_billed, "
    f"{_mean('BilledMonthlyRate')} AS avg_billed_rate, {_mean('CardRateMonth')} AS avg_card_rate, "
    f"{_mean('MonthlyRateVariance')} AS avg_variance"
)
_PCT = "round(avg(Pct), 6) AS avg_variance_pct"
_AT_OR_ABOVE, _BELOW = _n("MonthlyRateVariance >= 0"), _n("MonthlyRateVariance < 0")
_VARIANCE_BUCKET = (
    "CASE WHEN CardRateMonth IS NULL THEN 'No Card Rate' WHEN MonthlyRateVariance >= 0 THEN 'At or Above Card' "
    "WHEN MonthlyRateVariance * 10 >= -CardRateMonth THEN 'Within 10%' "
    "WHEN MonthlyRateVariance * 5 >= -CardRateMonth THEN '10-20% Below' ELSE 'More than 20% Below' END"
)
_UTIL_STATUS = "CASE WHEN {0} >= 0.8 THEN 'good' WHEN {0} >= 0.6 THEN 'warning' ELSE 'critical' END"
_RATE_STATUS = "CASE WHEN {0} >= 0 THEN 'good' WHEN {0} >= -0.1 THEN 'warning' ELSE 'critical' END"
_IDLE_STATUS = "CASE WHEN {0} <= 6 THEN 'good' WHEN {0} <= 12 THEN 'warning' ELSE 'critical' END"
_IN_BRANCH = f"Fleetcity = '{BRANCH}'"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _utilization(keys: str, source: str, where: str = "TRUE") -> str:
    names = ", ".join(part.split(" AS ")[0] for part in keys.split(", "))
    return f"SELECT {keys}, {_COUNTS}, {_FLEET_RATIO} AS utilization FROM {source} WHERE {where} GROUP BY {names}"


def _global(where: str = "TRUE") -> str:
    other = _n("Status NOT IN ('LEASED', 'AVAILABLE')")
    return (
        f"SELECT {_COUNTS}, {_FLEET_RATIO} AS utilization, {_AVAILABLE} AS available_trailers, {other} AS other_status "
        f"FROM fleet WHERE {where}"
    )


def _combined(where: str = "TRUE") -> str:
    def part(name: str, *keys: str) -> str:
        columns = ", ".join(
            (("Fleetcity" if key == "branch" else key) if key in keys else "NULL") + f" AS {key}"
            for key in ("branch", "type_bucket", "usage_category")
        )
        groups = ", ".join("Fleetcity" if key == "branch" else key for key in keys)
        blank = " AND Fleetcity <> ''" if name == "branch" else ""
        return (
            f"SELECT '{name}' AS breakdown, {columns}, {_COUNTS}, {_AVAILABLE} AS available_trailers, "
            f"coalesce({_FLEET_RATIO}, 0) AS utilization FROM fleet WHERE {where}{blank}"
            + (f" GROUP BY {groups}" if groups else "")
        )

    return " UNION ALL ".join(
        [
            part("global"),
            part("branch", "branch"),
            part("type", "type_bucket"),
            part("usage", "usage_category"),
            part("matrix", "type_bucket", "usage_category"),
        ]
    )


def _json_breakdown(alias: str, *keys: str, where: str = "TRUE") -> str:
    groups = ", ".join("Fleetcity" if key == "branch" else key for key in keys)
    fields = " || ',' || ".join(
        f"'\"{key}\":\"' || {'Fleetcity' if key == 'branch' else key} || '\"'" for key in keys
    )
    text = (
        f"'{{' || {fields} || ',\"total_trailers\":' || CAST(n AS VARCHAR) || "
        f"',\"leased_trailers\":' || CAST(leased AS VARCHAR) || '}}'"
    )
    return (
        f"(SELECT '[' || string_agg({text}, ',' ORDER BY {groups}) || ']' FROM (SELECT {groups}, count(*) AS n, "
        f"{_LEASED} AS leased FROM fleet WHERE {where} GROUP BY {groups}) g) AS {alias}"
    )


def _trend(keys: str, where: str) -> str:
    names = ", ".join(part.split(" AS ")[0] for part in keys.split(", "))
    return (
        f"SELECT {keys}, CAST(sum(NumRentedTrailers) AS BIGINT) AS leased_trailers, "
        f"CAST(sum(NumTrailers) AS BIGINT) AS total_trailers, "
        f"CAST(sum(NumRentedTrailers) AS DOUBLE) / NULLIF(sum(NumTrailers), 0) AS utilization "
        f"FROM statistics WHERE {where} GROUP BY {names}"
    )


def _two_months(where: str) -> str:
    return (
        "SELECT Month, CAST(sum(NumRentedTrailers) AS DOUBLE) / NULLIF(sum(NumTrailers), 0) AS utilization "
        f"FROM statistics WHERE {where} GROUP BY Month ORDER BY Month DESC LIMIT 2"
    )


def _mom(where: str) -> str:
    return (
        "SELECT CASE WHEN count(*) = 2 THEN max(CASE WHEN n = 1 THEN utilization END) "
        "- max(CASE WHEN n = 2 THEN utilization END) END AS mom_utilization_change "
        f"FROM (SELECT *, row_number() OVER (ORDER BY Month DESC) AS n FROM ({_two_months(where)}) m) r"
    )


def _branch_summary(where: str = "TRUE") -> str:
    return f"""
SELECT b.branch, b.total_trailers, b.leased_count, b.available_count, b.utilization,
  k.Type AS most_available_type, k.Length AS most_available_length, k.type_count AS most_available_count
FROM (SELECT Fleetcity AS branch, count(*) AS total_trailers, {_LEASED} AS leased_count,
    {_AVAILABLE} AS available_count, {_FLEET_RATIO} AS utilization FROM named WHERE {where} GROUP BY Fleetcity) b
LEFT JOIN ({_KINDS}) k ON b.branch = k.branch AND k.rank = 1"""


_KINDS = """SELECT branch, Type, Length, type_count, row_number() OVER (PARTITION BY branch
  ORDER BY type_count DESC, Type ASC NULLS FIRST, Length ASC NULLS FIRST) AS rank
FROM (SELECT Fleetcity AS branch, Type, Length, count(*) AS type_count FROM named WHERE Status = 'AVAILABLE'
  GROUP BY Fleetcity, Type, Length) k"""

_GLOBAL_LEVEL = "AggLevel = 'GLOBAL' AND Branch <> 'TBD'"
_BRANCH_LEVEL = f"AggLevel = 'BY_BRANCH' AND Branch = '{BRANCH}'"


def _idle_summary(source: str, where: str = "TRUE") -> str:
    return (
        "SELECT count(*) AS total_idle, coalesce(sum(AssetCost), 0) AS total_idle_cost, "
        f"{_MONTHS}, {_mean('CardRate')} AS avg_card_rate, coalesce(sum(CardRate), 0) AS total_opportunity_cost, "
        f"{_NEVER} AS total_never_leased, {_CRITICAL} AS critical_count FROM {source} WHERE {where}"
    )


def _idle_by(key: str, name: str, more: str = "", source: str = "idle") -> str:
    return f"SELECT {key} AS {name}, {_IDLE_MEASURES}{more} FROM {source} GROUP BY {key}"


_BY_BRANCH_MORE = f", {_CRITICAL} AS critical_count, {_NEVER} AS never_leased_count"
_COARSE = (
    "CASE WHEN MonthsIdle < 12 THEN '0-12 Months' WHEN MonthsIdle < 24 THEN '12-24 Months' ELSE '24+ Months' END"
)


def _breakdown(limit: str = "") -> str:
    return f"""
SELECT t.type_bucket, b.IdleDurationBucket AS max_duration_bucket,
  CAST(t.never AS DOUBLE) / NULLIF(t.units, 0) AS never_leased_pct, t.units AS total_type_units
FROM (SELECT TypeBucket AS type_bucket, count(*) AS units, {_NEVER} AS never FROM idle GROUP BY TypeBucket) t
LEFT JOIN (SELECT TypeBucket, IdleDurationBucket, row_number() OVER (PARTITION BY TypeBucket
    ORDER BY n DESC, CASE IdleDurationBucket WHEN '0-6 Months' THEN 1 WHEN '6-12 Months' THEN 2
      WHEN '12-24 Months' THEN 3 ELSE 4 END) AS rank
  FROM (SELECT TypeBucket, IdleDurationBucket, count(*) AS n FROM idle GROUP BY ALL) c) b
ON t.type_bucket = b.TypeBucket AND b.rank = 1
ORDER BY t.units DESC, t.type_bucket {limit}"""


_IDLE_UNIT = (
    "Unit AS unit, Branch AS branch, TypeBucket AS type_bucket, UsageCategory AS usage_category, "
    "LengthBucket AS length_bucket"
)


def _summary(where: str = "TRUE") -> str:
    return (
        f"SELECT {_RATES}, {_PCT}, {_AT_OR_ABOVE} AS at_or_above_card, {_BELOW} AS below_card FROM priced WHERE {where}"
    )


_LAST_MONTH = "(SELECT max(strftime(BillingStopDate, '%Y-%m')) FROM revenue WHERE Branch <> 'TBD')"


def _rates_last_month(where: str = "TRUE") -> str:
    return (
        f"SELECT {_LAST_MONTH} AS month, {_PCT}, {_AT_OR_ABOVE} AS at_or_above_card, {_BELOW} AS below_card "
        f"FROM priced WHERE strftime(BillingStopDate, '%Y-%m') = {_LAST_MONTH} AND {where}"
    )


_UNPRICED_BUCKETS = (
    "SELECT TypeBucket AS type_bucket, UsageCategory AS usage_category, LengthBucket AS length_bucket, "
    "count(DISTINCT UnitNumber) AS unit_count, sum(BilledMonthlyRate) AS total_revenue_at_risk "
    "FROM unpriced GROUP BY TypeBucket, UsageCategory, LengthBucket"
)
_REVENUE_COLUMNS = (
    "UnitNumber, Branch, TypeBucket, UsageCategory, LengthBucket, YearRange, "
    "strftime(BillingStartDate, '%Y-%m-%d') AS BillingStartDate, strftime(BillingStopDate, '%Y-%m-%d') AS BillingStopDate, "
    "BilledMonthlyRate, BilledDailyRate, BilledMileageRate, CardRateMonth, MonthlyRateVariance"
)
_LOCATED = (
    "Unit AS unit, Fleetcity AS branch, CustomerID AS customer_id, Latitude AS latitude, Longitude AS longitude, "
    "LastUpdate AS last_update, Speed AS speed, Heading AS heading, Address AS address, City AS gps_city, State AS gps_state"
)
_STATES = "SELECT State AS state, count(*) AS unit_count FROM positions WHERE State IS NOT NULL GROUP BY State"
_STALE = f"""
SELECT Unit AS unit, Fleetcity AS branch, CustomerID AS customer_id, LastUpdate AS last_update,
  date_diff('hour', LastUpdate, {AS_OF}) AS hours_since_update, Address AS last_known_address,
  City AS last_known_city, State AS last_known_state
FROM positions WHERE LastUpdate IS NULL OR LastUpdate < {AS_OF} - INTERVAL 24 HOUR"""


def _kpis(level: str, in_branch: str, lease_filter: str, since: str) -> str:
    newest = "(SELECT max(Month) FROM statistics WHERE Branch <> 'TBD')"
    before = f"(SELECT strftime(CAST({newest} || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m'))"
    first = f"CAST({newest} || '-01' AS DATE)"
    ratio = f"SELECT CAST(sum(NumRentedTrailers) AS DOUBLE) / NULLIF(sum(NumTrailers), 0) FROM statistics WHERE {level}"
    return f"""
SELECT x.*, {_UTIL_STATUS.format('current_utilization')} AS utilization_status,
  CASE WHEN mm_change >= 0 THEN 'good' ELSE 'critical' END AS mm_status,
  CASE WHEN new_leases >= ended_leases THEN 'good' ELSE 'warning' END AS lease_activity_status,
  CASE WHEN asset_churn_pct < 0.05 THEN 'good' ELSE 'warning' END AS churn_status
FROM (SELECT month, coalesce(NULLIF(cur, 0), live, 0) AS current_utilization, coalesce(prev, 0) AS previous_utilization,
    coalesce(cur, 0) - coalesce(prev, 0) AS mm_change, new_leases, ended_leases,
    coalesce(started, 0) AS leased_at_start, returned AS units_returned_latest,
    CASE WHEN started > 0 THEN CAST(returned AS DOUBLE) / started ELSE 0 END AS asset_churn_pct
  FROM (SELECT {newest} AS month, ({ratio} AND Month = {newest}) AS cur, ({ratio} AND Month = {before}) AS prev,
    (SELECT CAST(sum(NumRentedTrailers) AS BIGINT) FROM statistics WHERE {level} AND Month = {before}) AS started,
    (SELECT count(*) FROM leases WHERE {lease_filter} AND DateOn >= {since}) AS new_leases,
    (SELECT count(*) FROM leases WHERE {lease_filter} AND DateOff < {AS_OF} AND DateOff >= {since}) AS ended_leases,
    (SELECT count(*) FROM leases WHERE {lease_filter} AND DateOff >= {first} AND DateOff <= last_day({first})) AS returned,
    (SELECT {_FLEET_RATIO} FROM fleet WHERE {in_branch}) AS live) f) x"""


_ALERT_FIGURES = (
    f"SELECT coalesce((SELECT {_FLEET_RATIO} FROM fleet), 0) AS u, "
    f"coalesce((SELECT avg_variance_pct FROM ({_rates_last_month()}) r), 0) AS v"
)


def _overview(in_fleet: str = "TRUE", in_branch: str = "TRUE") -> str:
    return f"""
SELECT g.total_trailers, g.leased_trailers, g.available_trailers, g.utilization,
  least(greatest(coalesce(g.utilization, 0) * 100, 0), 100) AS gauge_percent,
  {_UTIL_STATUS.format('coalesce(g.utilization, 0)')} AS utilization_status,
  coalesce(NULLIF(i.total_idle, 0), g.available_trailers, 0) AS idle_assets,
  {_IDLE_STATUS.format('i.avg_months_idle')} AS idle_status,
  coalesce(i.critical_count, 0) AS critical_count,
  CASE WHEN i.critical_count > 0 THEN 'critical' ELSE 'good' END AS critical_status,
  coalesce(i.total_never_leased, 0) AS never_leased_count,
  CASE WHEN i.total_never_leased > 20 THEN 'warning' ELSE 'neutral' END AS never_leased_status,
  coalesce(r.avg_variance_pct, 0) AS avg_variance_pct,
  {_RATE_STATUS.format('coalesce(r.avg_variance_pct, 0)')} AS rate_status, r.at_or_above_card, r.below_card,
  CASE WHEN r.below_card > r.at_or_above_card THEN 'critical' ELSE 'warning' END AS below_card_status,
  s.n AS stale_gps_count, CASE WHEN s.n > 10 THEN 'warning' ELSE 'good' END AS stale_gps_status
FROM ({_global(in_fleet)}) g CROSS JOIN ({_idle_summary('idle', in_branch)}) i CROSS JOIN ({_rates_last_month(in_branch)}) r
CROSS JOIN (SELECT count(*) AS n FROM ({_STALE}) x WHERE {in_branch}) s"""


def _audit() -> str:
    from yardline.sources.schemas import INPUTS

    parts = []
    for table, schema in INPUTS.items():
        for field in schema:
            required = "FALSE" if field.nullable else "TRUE"
            parts.append(
                f"SELECT '{table}' AS table_name, count(*) AS row_count, '{field.name}' AS column_name, "
                f"TRUE AS present, {required} AS required, "
                f"{_n(f'{field.name} IS NULL')} AS null_count FROM {table}"
            )
    return " UNION ALL ".join(parts)


# Named periods, their labels and first days at AS_OF.
_PERIODS = (
    ("LTM", "Last 12 Months", "2000-11-15"),
    ("YTD", "Year to Date", "2000-12-15"),
    ("LQA", "Last Quarter (Annualized)", "2000-11-15"),
    ("L3M", "Last 3 Months", "2001-08-15"),
    ("L6M", "Last 6 Months", "2001-05-15"),
)


def _select_statements() -> dict[str, str]:
    pivot = ", ".join(
        f"CAST(sum(CASE WHEN usage_category = '{u}' AND Status = 'LEASED' THEN 1 ELSE 0 END) AS DOUBLE) / "
        f"NULLIF(sum(CASE WHEN usage_category = '{u}' THEN 1 ELSE 0 END), 0) AS {u}"
        for u in ("OTR_0", "OTR_1", "OTR_2", "CART_1", "CART_2", "STORAGE")
    )
    labels = (
        "CASE usage_category WHEN 'OTR_0' THEN 'OTR 0-3yr' WHEN 'OTR_1' THEN 'OTR 4-6yr' WHEN 'OTR_2' THEN 'OTR 7-8yr' "
        "WHEN 'CART_1' THEN 'Cartage 9-12yr' WHEN 'CART_2' THEN 'Cartage 13-16yr' ELSE 'Storage 16+yr' END"
    )
    type_labels = (
        "CASE TypeBucket WHEN 'DRY_VAN' THEN 'Dry Van' WHEN 'DRY_VAN_LIFTGATE' THEN 'Dry Van Liftgate' "
        "WHEN 'REEFER' THEN 'Reefer' WHEN 'REEFER_LIFTGATE' THEN 'Reefer Liftgate' WHEN 'FLATBED' THEN 'Flatbed' "
        "WHEN 'SPECIALTY' THEN 'Specialty' ELSE TypeBucket END"
    )
    position = (
        "CASE usage_category WHEN 'OTR_0' THEN 1 WHEN 'OTR_1' THEN 2 WHEN 'OTR_2' THEN 3 WHEN 'CART_1' THEN 4 "
        "WHEN 'CART_2' THEN 5 ELSE 6 END"
    )
    by_branch = _utilization("Fleetcity AS branch", "named")
    by_type = _utilization("type_bucket", "fleet")
    by_usage = _utilization("usage_category", "fleet")
    first_underscore = "regexp_replace({0}, '_', ' ')"
    branch_pct = f"SELECT Branch AS branch, {_RATES}, {_PCT} FROM priced GROUP BY Branch"
    type_rates = f"SELECT TypeBucket AS type_bucket, {_RATES} FROM priced GROUP BY TypeBucket"
    month_rates = f"SELECT strftime(BillingStopDate, '%Y-%m') AS month, {_RATES} FROM priced GROUP BY 1"
    classes = (
        f"SELECT {_VARIANCE_BUCKET} AS variance_bucket, count(*) AS invoice_count, sum(BilledMonthlyRate) AS total_billed "
        "FROM revenue WHERE Branch <> 'TBD' GROUP BY 1"
    )
    unit_dates = (
        "strftime(PurchaseDate, '%Y-%m-%d') AS PurchaseDate, strftime(SoldDate, '%Y-%m-%d') AS SoldDate"
    )
    short = _type(rare=False)
    inventory = (
        f"SELECT Unit, Fleetcity AS Branch, Status, Type, {short} AS TypeBucket, Year, Length, {_LENGTH} AS LengthBucket, "
        f"{_USAGE} AS UsageCategory, Make, VIN, Cost, {unit_dates} FROM trailers WHERE "
    )
    idle_columns = "Unit, Branch, TypeBucket, UsageCategory, LengthBucket, YearRange, AssetCost"
    report_idle = (
        f"SELECT {idle_columns}, LastActiveMonth, CumulativeLeases, MonthsIdle, IdleDurationBucket, CardRate "
        "FROM latest WHERE "
    )
    report_revenue = (
        f"SELECT {_REVENUE_COLUMNS}, Pct AS VariancePercent, InvoiceNo, LeaseNumber FROM revenue WHERE "
    )
    growth = "(CAST(total_billed AS DOUBLE) - CAST(before AS DOUBLE)) / NULLIF(CAST(before AS DOUBLE), 0)"
    money = "coalesce(sum(CASE WHEN LineKind = '{0}' THEN BilledMonthlyRate END), 0)"
    return {
        "type_bucket": f"SELECT Unit, {_type()} AS type_bucket FROM trailers",
        "type_bucket_short": f"SELECT Unit, {short} AS type_bucket FROM trailers",
        "usage_category": f"SELECT Unit, {_USAGE} AS usage_category FROM trailers",
        "length_bucket": f"SELECT Unit, {_LENGTH} AS length_bucket FROM trailers",
        "trailers_enriched": "SELECT Unit, Status, Fleetcity, Type, Year, Length, Make, VIN, Cost, "
        f"{unit_dates}, type_bucket, usage_category, length_bucket, year_range FROM enriched",
        "idle_history": "SELECT * FROM idle_all",
        "bucket_statistics": "SELECT * FROM statistics",
        "idle_history_incremental": "SELECT * FROM idle_all",
        "bucket_statistics_incremental": "SELECT * FROM statistics",
        "idle_summary_stored": _idle_summary("idle"),
        "idle_by_duration_stored": _idle_by("IdleDurationBucket", "idle_bucket"),
        "utilization_by_branch_collated": f"SELECT Fleetcity AS branch, {_COUNTS}, {_FLEET_RATIO} AS utilization FROM one_spelling "
        "WHERE Status IN ('AVAILABLE', 'LEASED') AND Fleetcity IS NOT NULL AND trim(Fleetcity) <> '' AND Fleetcity <> 'TBD' GROUP BY 1",
        "length_labelled": "SELECT length_bucket, length_bucket || '''' AS name, "
        f"{_FLEET_RATIO} AS utilization, count(*) AS total, {_LEASED} AS leased FROM fleet GROUP BY length_bucket",
        "idle_duration_options": "SELECT replace(IdleDurationBucket, ' Months', '') AS value, IdleDurationBucket AS label, "
        "count(*) AS unit_count FROM idle GROUP BY IdleDurationBucket",
        "revenue_by_period": " UNION ALL ".join(
            f"SELECT '{period}' AS period, '{label}' AS label, DATE '{first}' AS first_day, count(*) AS invoice_count, "
            f"sum(BilledMonthlyRate) AS total_billed FROM priced WHERE BillingStopDate >= DATE '{first}'"
            for period, label, first in _PERIODS
        ),
        "revenue_details": f"SELECT {_REVENUE_COLUMNS}, InvoiceNo, LeaseNumber FROM revenue",
        "global_utilization": _global(),
        "global_utilization_of_branch": _global(_IN_BRANCH),
        "status_counts": "SELECT Status AS status, count(*) AS unit_count FROM trailers GROUP BY Status",
        "utilization_by_branch": by_branch,
        "utilization_by_type": by_type,
        "utilization_by_usage": by_usage,
        "utilization_matrix": _utilization("type_bucket, usage_category", "fleet"),
        "utilization_by_branch_filtered": _utilization("Fleetcity AS branch", "named", "type_bucket = 'DRY_VAN'"),
        "utilization_by_usage_filtered": _utilization(
            "usage_category", "fleet", f"{_IN_BRANCH} AND type_bucket = 'DRY_VAN'"
        ),
        "utilization_matrix_filtered": _utilization(
            "type_bucket, usage_category", "fleet", "type_bucket = 'REEFER' AND usage_category = 'OTR_0'"
        ),
        "fleet_combined_filtered": _combined("type_bucket = 'DRY_VAN'"),
        "utilization_display": "SELECT printf('%.1f%%', coalesce(utilization, 0) * 100) AS value, "
        "format('{:,}', leased_trailers) || ' of ' || format('{:,}', total_trailers) || ' on rent' AS subtitle, "
        f"{_UTIL_STATUS.format('coalesce(utilization, 0)')} AS status, "
        f"least(greatest(coalesce(utilization, 0) * 100, 0), 100) AS gauge_percent FROM ({_global()}) g",
        "utilization_pivot": f"SELECT type_bucket, {pivot} FROM fleet GROUP BY type_bucket",
        "utilization_by_branch_type_age": _utilization("Fleetcity AS branch, type_bucket, usage_category", "named"),
        "usage_labelled": f"SELECT {position} AS position, usage_category, {labels} AS name, utilization, "
        f"total_trailers AS total, leased_trailers AS leased FROM ({by_usage}) u",
        "type_chart": f"SELECT {first_underscore.format('type_bucket')} AS name, utilization, total_trailers AS total, "
        f"leased_trailers AS leased FROM ({by_type}) t",
        "fleet_combined": _combined(),
        "fleet_combined_of_branch": _combined(_IN_BRANCH),
        "fleet_combined_nested": "SELECT (SELECT count(*) FROM fleet) AS total_trailers, "
        f"(SELECT {_LEASED} FROM fleet) AS leased_trailers, (SELECT {_AVAILABLE} FROM fleet) AS available_trailers, "
        + ", ".join(
            [
                _json_breakdown("by_branch_json", "branch", where="Fleetcity <> ''"),
                _json_breakdown("by_type_json", "type_bucket"),
                _json_breakdown("by_usage_json", "usage_category"),
                _json_breakdown("matrix_json", "type_bucket", "usage_category"),
            ]
        ),
        "fleet_combined_parsed": _utilization("type_bucket, usage_category", "fleet"),
        "utilization_trend": _trend("Month", f"{_GLOBAL_LEVEL} AND Month >= '2000-11'"),
        "utilization_trend_of_branch": _trend("Month", f"{_BRANCH_LEVEL} AND Month >= '2000-11'"),
        "utilization_trend_by_branch": _trend(
            "Month, Branch AS branch",
            "AggLevel = 'BY_BRANCH' AND Month >= '2000-11' AND Branch <> 'ALL' AND Branch <> 'TBD'",
        ),
        "latest_two_months": _two_months(_GLOBAL_LEVEL),
        "mom_change": _mom(_GLOBAL_LEVEL),
        "mom_change_of_branch": _mom(_BRANCH_LEVEL),
        "active_branches": "SELECT DISTINCT Fleetcity AS branch FROM fleet",
        "branch_summary": _branch_summary(),
        "branch_summary_of_branch": _branch_summary(_IN_BRANCH),
        "most_available_type": f"SELECT * FROM ({_KINDS}) r WHERE rank = 1",
        "branch_composition": "SELECT Fleetcity AS branch, type_bucket, count(*) AS total_count, "
        f"{_LEASED} AS leased_count FROM named GROUP BY Fleetcity, type_bucket",
        "branch_status": f"SELECT branch, utilization, {_UTIL_STATUS.format('utilization')} AS status, "
        "CASE WHEN utilization >= 0.8 THEN 'full' WHEN utilization >= 0.7 THEN 'high' WHEN utilization >= 0.6 THEN 'mid' "
        f"WHEN utilization >= 0.4 THEN 'low' ELSE 'empty' END AS utilization_class FROM ({by_branch}) b",
        "bottom_branches": f"SELECT * FROM ({by_branch}) b ORDER BY utilization, branch LIMIT 5",
        "branch_comparison": f"""
SELECT b.branch, b.utilization, coalesce(r.mtd, 0) AS revenue_mtd, coalesce(r.ytd, 0) AS revenue_ytd,
  coalesce(i.n, 0) AS idle_count
FROM ({by_branch}) b
LEFT JOIN (SELECT Branch, sum(CASE WHEN BillingStopDate >= DATE '2001-11-01' THEN BilledMonthlyRate END) AS mtd,
    sum(BilledMonthlyRate) AS ytd FROM revenue WHERE BillingStopDate BETWEEN DATE '2001-01-01' AND {TODAY}
  GROUP BY Branch) r ON b.branch = r.Branch
LEFT JOIN (SELECT Branch, count(*) AS n FROM latest GROUP BY Branch) i ON b.branch = i.Branch""",
        "idle_summary": _idle_summary("idle"),
        "idle_summary_latest_month": _idle_summary("idle"),
        "idle_summary_of_branch": _idle_summary("idle", f"Branch = '{BRANCH}'"),
        "idle_summary_all_branches": _idle_summary("latest"),
        "idle_status": f"SELECT avg_months_idle, {_IDLE_STATUS.format('avg_months_idle')} AS status "
        f"FROM ({_idle_summary('idle')}) s",
        "idle_by_duration": _idle_by("IdleDurationBucket", "idle_bucket"),
        "idle_by_duration_latest_month": _idle_by("IdleDurationBucket", "idle_bucket"),
        "idle_by_duration_coarse": f"SELECT {_COARSE} AS idle_bucket, {_IDLE_MEASURES} FROM idle GROUP BY 1",
        "idle_by_branch": _idle_by("Branch", "branch", _BY_BRANCH_MORE),
        "idle_by_branch_all_branches": _idle_by("Branch", "branch", _BY_BRANCH_MORE, "latest"),
        "idle_by_type": _idle_by("TypeBucket", "type_bucket"),
        "idle_by_usage": _idle_by("UsageCategory", "usage_category"),
        "idle_trend": f"SELECT MonthStr AS month, count(*) AS unit_count, {_MONTHS}, {_LOST}, "
        f"{_CRITICAL} AS critical_count FROM idle_all GROUP BY MonthStr",
        "idle_summary_filtered": _idle_summary("idle", "TypeBucket = 'DRY_VAN' AND UsageCategory = 'CART_1'"),
        "idle_by_branch_filtered": _idle_by(
            "Branch",
            "branch",
            _BY_BRANCH_MORE,
            "(SELECT * FROM idle WHERE TypeBucket = 'DRY_VAN' AND IdleDurationBucket = '0-6 Months') i",
        ),
        "idle_by_duration_filtered": _idle_by(
            "IdleDurationBucket", "idle_bucket", "", f"(SELECT * FROM idle WHERE Branch = '{BRANCH}' AND UsageCategory = 'STORAGE') i"
        ),
        "idle_matrix_filtered": "SELECT Branch AS branch, IdleDurationBucket AS idle_bucket, count(*) AS unit_count, "
        f"{_COST} FROM idle WHERE Branch = '{BRANCH}' AND IdleDurationBucket = '0-6 Months' GROUP BY Branch, IdleDurationBucket",
        "idle_matrix": "SELECT Branch AS branch, IdleDurationBucket AS idle_bucket, count(*) AS unit_count, "
        f"{_COST} FROM idle GROUP BY Branch, IdleDurationBucket",
        "idle_breakdown": _breakdown(),
        "idle_breakdown_top": _breakdown("LIMIT 5"),
        "idle_top_branches": f"SELECT Branch AS name, count(*) AS total, {_CRITICAL} AS critical, {_NEVER} AS never_leased "
        "FROM idle GROUP BY Branch ORDER BY total DESC, name LIMIT 15",
        "never_leased": f"SELECT {_IDLE_UNIT}, AssetCost AS asset_cost, MonthsIdle AS months_idle, CardRate AS card_rate "
        "FROM idle WHERE CumulativeLeases = 0",
        "never_leased_by_branch": f"SELECT Branch AS branch, count(*) AS unit_count, {_COST}, {_MONTHS} "
        "FROM idle WHERE CumulativeLeases = 0 GROUP BY Branch",
        "never_leased_share": f"SELECT Branch AS branch, {_NEVER} AS never_leased_count, count(*) AS unit_count, "
        f"{_ratio(_NEVER, 'count(*)')} AS never_leased_share, {_MONTHS} FROM idle GROUP BY Branch HAVING {_NEVER} > 0",
        "critical_idle": f"SELECT {_IDLE_UNIT}, YearRange AS year_range, AssetCost AS asset_cost, MonthsIdle AS months_idle, "
        "LastActiveMonth AS last_active_month, CumulativeLeases AS total_leases, CardRate AS card_rate "
        "FROM idle WHERE IdleDurationBucket = '24+ Months'",
        "critical_idle_top": "SELECT Unit AS unit, Branch AS branch, TypeBucket AS type_bucket, "
        "UsageCategory AS usage_category, MonthsIdle AS months_idle, coalesce(LastActiveMonth, 'Never') AS last_active, "
        "CumulativeLeases AS total_leases, CardRate AS card_rate FROM idle WHERE IdleDurationBucket = '24+ Months' "
        "ORDER BY MonthsIdle DESC, Unit LIMIT 25",
        "critical_idle_table": f"SELECT Unit AS unit, Branch AS branch, {type_labels} AS type, "
        f"{labels.replace('CASE usage_category', 'CASE UsageCategory')} AS usage, MonthsIdle AS months_idle, "
        "coalesce(LastActiveMonth, 'Never') AS last_active, CASE WHEN CardRate <> 0 "
        "THEN '$' || format('{:,}', CAST(round(CardRate, 0) AS BIGINT)) ELSE '—' END AS card_rate "
        "FROM idle WHERE IdleDurationBucket = '24+ Months' ORDER BY MonthsIdle DESC, Unit LIMIT 25",
        "idle_units_last_rate": f"""
SELECT e.Unit AS unit, e.Fleetcity AS branch, date_diff('day', coalesce(l.last_off, e.PurchaseDate), {TODAY}) AS days_idle,
  (SELECT Rate FROM leases x WHERE x.Unit = e.Unit AND x.DateOn <= {TODAY} ORDER BY DateOn DESC, LeaseID DESC LIMIT 1)
    AS last_lease_rate, e.type_bucket, e.usage_category
FROM enriched e LEFT JOIN (SELECT Unit, max(DateOff) AS last_off FROM leases WHERE DateOn <= {TODAY} GROUP BY Unit) l
  ON e.Unit = l.Unit
WHERE e.PurchaseDate <= {TODAY} AND (e.SoldDate IS NULL OR e.SoldDate > {TODAY})
  AND NOT EXISTS (SELECT 1 FROM leases f WHERE f.Unit = e.Unit AND f.DateOn <= {TODAY}
    AND (f.DateOff IS NULL OR f.DateOff > {TODAY}))""",
        "variance_pct": "SELECT InvoiceNo, LeaseNumber, UnitNumber, BilledMonthlyRate, CardRateMonth, "
        f"Pct AS variance_pct, {_VARIANCE_BUCKET} AS variance_bucket FROM revenue WHERE Branch <> 'TBD'",
        "revenue_summary": _summary(),
        "revenue_summary_of_branch": _summary(f"Branch = '{BRANCH}'"),
        "revenue_summary_of_period": _summary("BillingStopDate >= DATE '2001-05-15'"),
        "invoice_totals": "SELECT h.InvoiceNo AS invoice_no, h.CustomerID AS customer_id, h.InvoiceDate AS invoice_date, "
        "count(l.InvoiceNo) AS line_count, coalesce(sum(l.BilledMonthlyRate), 0) AS total_billed "
        "FROM invoice_headers h LEFT JOIN invoice_lines l ON h.InvoiceNo = l.InvoiceNo GROUP BY 1, 2, 3",
        "invoice_reconciliation": "SELECT * FROM reconciled",
        "invoice_reconciliation_summary": "SELECT status, count(*) AS invoice_count, CAST(sum(line_count) AS BIGINT) AS line_count, "
        "sum(stated_total) AS stated_total, sum(line_total) AS line_total FROM reconciled GROUP BY status",
        "lines_without_header": "SELECT InvoiceNo AS invoice_no, LeaseNumber AS lease_number, UnitNumber AS unit, "
        "BillingStopDate AS billing_stop_date, BilledMonthlyRate AS billed_monthly_rate "
        "FROM invoice_lines WHERE InvoiceNo NOT IN (SELECT InvoiceNo FROM invoices)",
        "headers_without_lines": "SELECT InvoiceNo AS invoice_no, CustomerID AS customer_id, InvoiceDate AS invoice_date "
        "FROM invoices WHERE InvoiceNo NOT IN (SELECT InvoiceNo FROM invoice_lines)",
        "rate_share": f"SELECT count(*) AS invoice_count, {_ratio(_AT_OR_ABOVE, 'count(*)')} AS at_or_above_share, "
        f"{_ratio(_BELOW, 'count(*)')} AS below_share, "
        f"CASE WHEN {_BELOW} > {_AT_OR_ABOVE} THEN 'critical' ELSE 'warning' END AS below_status FROM priced",
        "revenue_by_branch": branch_pct,
        "branch_rate_status": f"SELECT branch, coalesce(avg_variance_pct, 0) AS variance, "
        f"{_RATE_STATUS.format('coalesce(avg_variance_pct, 0)')} AS status FROM ({branch_pct}) b",
        "revenue_by_type": type_rates,
        "revenue_type_chart": f"SELECT {first_underscore.format('type_bucket')} AS name, avg_billed_rate AS billed, "
        f"avg_card_rate AS card, avg_variance AS variance FROM ({type_rates}) t",
        "revenue_by_usage": f"SELECT UsageCategory AS usage_category, {_RATES} FROM priced GROUP BY UsageCategory",
        "revenue_trend": month_rates,
        "revenue_latest_month": _rates_last_month(),
        "revenue_latest_month_of_branch": _rates_last_month(f"Branch = '{BRANCH}'"),
        "variance_distribution": classes,
        "variance_shares": "SELECT *, CAST(invoice_count AS DOUBLE) / (SELECT count(*) FROM revenue WHERE Branch <> 'TBD') "
        f"AS share FROM ({classes}) c",
        "units_without_card_rate": "SELECT UnitNumber AS unit, Branch AS branch, TypeBucket AS type_bucket, "
        "UsageCategory AS usage_category, LengthBucket AS length_bucket, YearRange AS year_range, "
        "CAST(sum(BilledMonthlyRate) AS DOUBLE) / count(*) AS avg_billed_rate, count(*) AS invoice_count, "
        "sum(BilledMonthlyRate) AS total_billed FROM unpriced "
        "GROUP BY UnitNumber, Branch, TypeBucket, UsageCategory, LengthBucket, YearRange",
        "units_without_card_rate_summary": _UNPRICED_BUCKETS,
        "units_without_card_rate_top": f"{_UNPRICED_BUCKETS} ORDER BY unit_count DESC, TypeBucket, UsageCategory, "
        "LengthBucket LIMIT 10",
        "revenue_at_risk_total": "SELECT CAST(coalesce(sum(unit_count), 0) AS BIGINT) AS total_units, "
        f"coalesce(sum(total_revenue_at_risk), 0) AS total_revenue_at_risk FROM ({_UNPRICED_BUCKETS}) b",
        "recent_revenue_by_branch": "SELECT Branch AS branch, sum(BilledMonthlyRate) AS total_revenue, "
        "count(*) AS invoice_count FROM revenue WHERE BillingStopDate >= TIMESTAMP '2001-10-15 12:00:00' GROUP BY Branch",
        "revenue_growth": f"SELECT month, total_billed, before AS previous_billed, {growth} AS growth, "
        f"CASE WHEN {growth} IS NULL THEN NULL WHEN {growth} >= 0.05 THEN 'good' WHEN {growth} >= 0 THEN 'warning' "
        f"ELSE 'critical' END AS status FROM (SELECT month, total_billed, lag(total_billed) OVER (ORDER BY month) AS before "
        f"FROM ({month_rates}) m) g",
        "revenue_components": "SELECT strftime(BillingStopDate, '%Y-%m') AS month, Branch AS branch, "
        f"{money.format('LEASE')} AS lease_revenue, {money.format('MILEAGE')} AS mileage_revenue, "
        f"{money.format('REPAIR')} AS repair_revenue, sum(BilledMonthlyRate) AS total_revenue FROM revenue GROUP BY 1, 2",
        "rate_realization": f"""
SELECT l.Unit AS unit, l.LeaseID, r.Fleetcity AS branch, r.type_bucket, r.usage_category, r.length_bucket,
  l.Rate AS current_rate, r.CardRateMonth AS card_rate,
  CASE WHEN r.CardRateMonth > 0 THEN CAST(l.Rate AS DOUBLE) / CAST(NULLIF(r.CardRateMonth, 0) AS DOUBLE) END
    AS rate_realization,
  CASE WHEN r.CardRateMonth > 0 THEN CAST(l.Rate - r.CardRateMonth AS DOUBLE)
    / CAST(NULLIF(r.CardRateMonth, 0) AS DOUBLE) END AS variance_pct
FROM leases l JOIN rated r ON l.Unit = r.Unit
WHERE l.LeaseStatus = 'ACTIVE' AND l.DateOn <= {AS_OF} AND (l.DateOff IS NULL OR l.DateOff > {AS_OF})""",
        "leased_locations": f"SELECT {_LOCATED}, {_type()} AS type_bucket FROM located",
        "leased_locations_map": f"SELECT {_LOCATED}, {short} AS type_bucket FROM located "
        "ORDER BY Unit, CustomerID LIMIT 1000",
        "leased_locations_filtered": f"SELECT {_LOCATED}, {_type()} AS type_bucket FROM located "
        f"WHERE {_IN_BRANCH} AND {_type()} = 'REEFER'",
        "locations_by_state_of_branch": "SELECT State AS state, count(*) AS unit_count FROM positions "
        f"WHERE State IS NOT NULL AND {_IN_BRANCH} GROUP BY State",
        "stale_gps_of_branch": f"SELECT * FROM ({_STALE}) s WHERE branch = '{BRANCH}'",
        "location_bounds": "SELECT min(Latitude) AS south, max(Latitude) AS north, min(Longitude) AS west, "
        "max(Longitude) AS east, count(*) AS located_rows FROM located",
        "locations_by_state": _STATES,
        "state_share": "SELECT state, unit_count, least(CAST(unit_count AS DOUBLE) / "
        "NULLIF((SELECT count(*) FROM located), 0) * 100, 100) AS share_percent "
        f"FROM ({_STATES}) s ORDER BY unit_count DESC, state LIMIT 15",
        "location_cards": "SELECT (SELECT count(*) FROM located) AS trailers_with_gps, "
        f"(SELECT count(*) FROM ({_STATES}) s) AS states_covered, "
        f"(SELECT state FROM ({_STATES}) s ORDER BY unit_count DESC, state LIMIT 1) AS top_state, "
        f"(SELECT max(unit_count) FROM ({_STATES}) s) AS top_state_units, "
        f"(SELECT count(*) FROM ({_STALE}) x) AS stale_count",
        "stale_gps": _STALE,
        "stale_gps_top": "SELECT unit, branch, customer_id, CASE WHEN hours_since_update <> 0 "
        "THEN CAST(hours_since_update AS VARCHAR) ELSE 'N/A' END AS hours, "
        "CASE WHEN last_known_city <> '' AND last_known_state <> '' THEN last_known_city || ', ' || last_known_state "
        f"ELSE 'Unknown' END AS last_location FROM ({_STALE} "
        "ORDER BY last_update ASC NULLS FIRST, unit, customer_id LIMIT 50) s",
        "away_from_branch": "SELECT Unit AS unit, Fleetcity AS home_branch, City AS current_city, State AS current_state, "
        "CustomerID AS customer_id FROM positions WHERE State IS NOT NULL",
        "fleet_kpis": _kpis(_GLOBAL_LEVEL, "TRUE", "TRUE", "TIMESTAMP '2000-11-15 12:00:00'"),
        "fleet_kpis_of_branch": _kpis(
            _BRANCH_LEVEL,
            _IN_BRANCH,
            f"Unit IN (SELECT Unit FROM trailers WHERE {_IN_BRANCH})",
            "TIMESTAMP '2001-08-15 12:00:00'",
        ),
        "alerts": f"""
SELECT * FROM (
  SELECT 'critical' AS severity, 'utilization_below_70_percent' AS alert, round(u, 6) AS value FROM ({_ALERT_FIGURES}) f
    WHERE u < 0.7
  UNION ALL SELECT 'warning', 'rates_over_10_percent_below_card', round(v, 6) FROM ({_ALERT_FIGURES}) f WHERE v < -0.1
  UNION ALL SELECT 'good', 'fleet_performance_healthy', round(u, 6) FROM ({_ALERT_FIGURES}) f
    WHERE NOT (u < 0.7) AND NOT (v < -0.1)) a""",
        "overview_kpis": _overview(),
        "overview_kpis_of_branch": _overview(_IN_BRANCH, f"Branch = '{BRANCH}'"),
        "report_utilization": f"SELECT Unit, Fleetcity AS Branch, Status, Type, Year, Length, {short} AS TypeBucket, "
        f"{_USAGE} AS UsageCategory, Cost, strftime(PurchaseDate, '%Y-%m-%d') AS PurchaseDate FROM trailers "
        "WHERE Status IN ('AVAILABLE', 'LEASED')",
        "report_utilization_filtered": f"SELECT Unit, Fleetcity AS Branch, Status, Type, Year, Length, {short} AS TypeBucket, "
        f"{_USAGE} AS UsageCategory, Cost, strftime(PurchaseDate, '%Y-%m-%d') AS PurchaseDate FROM trailers "
        f"WHERE Status IN ('AVAILABLE', 'LEASED') AND {short} = 'REEFER' AND {_USAGE} = 'OTR_0'",
        "report_inventory": inventory + "Status IN ('AVAILABLE', 'LEASED')",
        "report_inventory_filtered": inventory + f"Status = 'BOS' AND {_IN_BRANCH} AND {short} = 'DRY_VAN'",
        "report_revenue": report_revenue + "TRUE",
        "report_revenue_filtered": report_revenue
        + f"Branch = '{BRANCH}' AND TypeBucket = 'REEFER' AND BillingStopDate >= DATE '2001-05-15'",
        "report_idle": report_idle + "TRUE",
        "report_idle_latest_month": report_idle + "TRUE",
        "report_idle_filtered": report_idle
        + f"Branch = '{BRANCH}' AND TypeBucket = 'DRY_VAN' AND IdleDurationBucket = '6-12 Months'",
        "report_critical_idle": f"SELECT {idle_columns}, LastActiveMonth, CumulativeLeases AS TotalLeases, MonthsIdle, "
        "CardRate AS MonthlyOpportunityCost FROM latest WHERE IdleDurationBucket = '24+ Months'",
        "report_never_leased": f"SELECT {idle_columns}, MonthsIdle AS MonthsSincePurchase, "
        "CardRate AS MonthlyOpportunityCost FROM latest WHERE CumulativeLeases = 0",
        "report_critical_idle_filtered": f"SELECT {idle_columns}, LastActiveMonth, CumulativeLeases AS TotalLeases, MonthsIdle, "
        f"CardRate AS MonthlyOpportunityCost FROM latest WHERE IdleDurationBucket = '24+ Months' AND Branch = '{BRANCH}'",
        "report_never_leased_filtered": f"SELECT {idle_columns}, MonthsIdle AS MonthsSincePurchase, "
        "CardRate AS MonthlyOpportunityCost FROM latest WHERE CumulativeLeases = 0 AND TypeBucket = 'DRY_VAN'",
        "report_locations_filtered": f"SELECT Unit, Fleetcity AS HomeBranch, CustomerID AS Customer, Type, {short} AS TypeBucket, "
        "Latitude, Longitude, Address, City AS CurrentCity, State AS CurrentState, Speed, Heading, "
        f"{_ISO.format('LastUpdate')} AS LastUpdate FROM located WHERE State = 'S03'",
        "report_locations": f"SELECT Unit, Fleetcity AS HomeBranch, CustomerID AS Customer, Type, {short} AS TypeBucket, "
        "Latitude, Longitude, Address, City AS CurrentCity, State AS CurrentState, Speed, Heading, "
        f"{_ISO.format('LastUpdate')} AS LastUpdate FROM located",
        "csv_round_trip": "SELECT Unit, NULLIF(Branch, '') AS Branch, Status, NULLIF(Type, '') AS Type, TypeBucket, Year, "
        "NULLIF(Length, '') AS Length, LengthBucket, UsageCategory, Make, VIN, Cost, CAST(PurchaseDate AS DATE) AS PurchaseDate, "
        f"CAST(SoldDate AS DATE) AS SoldDate FROM ({inventory} Status IN ('AVAILABLE', 'LEASED')) i",
        "revenue_export": f"SELECT * REPLACE (NULLIF(Branch, '') AS Branch) FROM ({report_revenue} TRUE) r",
        "source_audit": _audit(),
        "sql_text": "SELECT Status AS status, max(Cost) AS highest_cost FROM trailers GROUP BY Status",
        "sql_text_with_parameters": "SELECT t.Fleetcity AS branch, count(*) AS lease_count, sum(l.Rate) AS total_rate "
        "FROM leases l JOIN trailers t ON l.Unit = t.Unit WHERE t.Fleetcity <> 'TBD' AND l.DateOn >= DATE '1996-01-01' GROUP BY 1",
    }


def _needed(text: str) -> list[str]:
    """CTEs a statement reads, directly or through others, in order."""
    wanted: set[str] = set()
    for name in reversed(_CTES):
        bodies = [text, *(_CTES[used] for used in wanted)]
        if any(re.search(rf"\b(FROM|JOIN)\s+{name}\b", body) for body in bodies):
            wanted.add(name)
    return [name for name in _CTES if name in wanted]


def _derived(of: dict[str, str]) -> dict[str, str]:
    """Statements that repeat others: stored forms, and the row counts of the reports."""
    # File name stem of each report.
    files = {
        "utilization": "utilization-report",
        "inventory": "fleet-inventory",
        "revenue": "revenue-report",
        "idle": "idle-assets-report",
        "critical_idle": "critical-idle-report",
        "never_leased": "never-leased-report",
        "locations": "trailer-locations",
    }
    told = "SELECT 'all' AS selection, '{0}-2001-11-15.csv' AS file, count(*) AS rows, 'ok' AS status, count(*) AS rows_read FROM ({1}) r"
    counts = [told.format(file, of[f"report_{report}"]) for report, file in files.items()]
    counts.append("SELECT 'none', 'utilization-report-2001-11-15.csv', 0, 'no data', 0")
    empty = "SELECT 'fleet-inventory-2001-11-15.csv' AS file, count(*) AS rows, 'no data' AS status FROM trailers WHERE Status = 'NO SUCH STATUS'"
    other = {
        "idle_trend_stored": "idle_trend",
        "utilization_trend_stored": "utilization_trend",
        "latest_two_months_stored": "latest_two_months",
        "idle_history_bucketed": "idle_history",
        "revenue_details_bucketed": "revenue_details",
        "locations_by_state_collated": "locations_by_state",
    }
    return {"export_status": " UNION ALL ".join(counts), "empty_export": empty} | {name: of[known] for name, known in other.items()}


def statements() -> dict[str, str]:
    full, selects = {}, _select_statements()
    for key, text in (selects | _derived(selects)).items():
        ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in _needed(text))
        full[key] = f"WITH {ctes}\n{text.strip()}"
    return full
