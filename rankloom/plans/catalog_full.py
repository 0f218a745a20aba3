"""Oracle of the whole training table (``features_full``) in DuckDB SQL.

Built stage by stage from the same view texts; the tie-break column list of
the (item, request) dedup is read with DESCRIBE on the sample tables, the
same way the output normalisation reads column types.
"""

from __future__ import annotations

from ..fixtures import duck_with
from .catalog_features import BASE_SQL_COLS, PREPARED_CTES, PREP_VIEWS
from .catalog_geo import BEST
from .catalog_rates import rates_ctes
from .registry import _duck_con

ZERO_FILL = ["iscitysearch", "item_user_btod", "item_user_ctr", "item_user_br", "item_ctr", "item_btod",
             "item_br", "avg_item_btod", "avg_item_br", "avg_item_ctr", "user_abp"]
RATES = ("ctr", "br", "dtob")
KEYS = {"item": ["itemid"], "item_place": ["itemid", "placeid"], "user_cat": ["userid", "display_category"]}
CLICK_ORDER = ["searchtime", "requestid", "itemid", "event", "bookingid", "fprice", "distance", "rating", "item_type"]
FIELDS = ["itemid", "item_type", "fprice", "distance", "rating"]
TARGET_RANK = ("CASE WHEN target = 'realised' THEN 0 WHEN target = 'booking' THEN 1 "
               "WHEN target = 'hotel_details_page' THEN 2 ELSE 3 END")
VIEWS = PREP_VIEWS + ["item_geo"]


def _nf(cols):
    return ", ".join(f"{c} NULLS FIRST" for c in cols)


def _upto_b6() -> str:
    fills = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in ZERO_FILL)
    rates = ",\n".join(rates_ctes(k, p, src="prepared") for p, k in KEYS.items())
    rate_cols = ", ".join(f"{p}_rates.{p}_{r}" for p in KEYS for r in RATES)
    rate_joins = " ".join(f"LEFT JOIN {p}_rates USING ({', '.join(k)}, searchdate)" for p, k in KEYS.items())
    fallback = ", ".join(f"CASE WHEN iscitysearch = 1 AND placeid IS NULL THEN item_{r} ELSE item_place_{r} END "
                         f"AS item_place_{r}" for r in RATES)
    payload = ", ".join(f"'{f}': {f}" for f in FIELDS)
    return f""", {PREPARED_CTES},
b0 AS (SELECT {BASE_SQL_COLS} FROM prepared),
b1 AS (SELECT * REPLACE ({fills},
                         COALESCE(ratingMean, (SELECT avg(rating) FROM prepared)) AS ratingMean,
                         COALESCE(ratingCount, (SELECT avg(rcount) FROM prepared)) AS ratingCount)
         FROM b0 WHERE requestid IN (SELECT requestid FROM prepared WHERE event IS NOT NULL)),
{rates},
b2 AS (SELECT b1.* EXCLUDE (item_ctr, item_br), {rate_cols} FROM b1 {rate_joins}),
b3 AS (SELECT * REPLACE ({fallback}),
              CASE WHEN iscitysearch = 0 AND is_nearBy_search = 0 THEN 1 ELSE 0 END AS is_locality_search FROM b2),
{BEST},
b4 AS (SELECT b3.* REPLACE (CASE WHEN b3.iscitysearch = 1 THEN best.distance_backfill ELSE b3.distance END AS distance)
         FROM b3 LEFT JOIN best USING (itemid)),
b5 AS (SELECT b4.*, ic.cityid_item FROM b4
         JOIN (SELECT DISTINCT itemid, cityid AS cityid_item FROM item_geo) ic
           ON ic.itemid = b4.itemid AND b4.cityid = ic.cityid_item),
h_single AS (SELECT * FROM clean WHERE requestid IN (
               SELECT requestid FROM clean GROUP BY requestid HAVING COUNT(DISTINCT bookingid) < 2)),
h_prev AS (SELECT *, COALESCE(list({{'r': requestid, {payload}}})
                   OVER (PARTITION BY userid ORDER BY {_nf(CLICK_ORDER)} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS p
             FROM h_single WHERE event IS NOT NULL),
h_hist AS (SELECT *, list_slice(o, greatest(len(o) - 9, 1), len(o)) AS h
             FROM (SELECT *, list_filter(p, lambda x: x.r IS DISTINCT FROM requestid) AS o FROM h_prev)),
h_req AS (SELECT requestid, h FROM (SELECT requestid, h, row_number() OVER (PARTITION BY requestid
                                     ORDER BY {_nf(CLICK_ORDER)}) AS rn FROM h_hist) WHERE rn = 1),
b6 AS (SELECT b5.*, h_req.h FROM b5 JOIN h_req USING (requestid))"""


def _rest(sample_dir: str) -> list[str]:
    sql = duck_with(VIEWS, _upto_b6() + "\nSELECT * FROM b6")
    cols = [r[0] for r in _duck_con(sample_dir).execute(f"DESCRIBE {sql}").fetchall()]
    return sorted(c for c in cols if c not in ("itemid", "requestid", "h"))


def full_sql(sample_dir: str) -> str:
    rest = _rest(sample_dir)
    lists = {f: f"list_transform(h, lambda x: x.{f})" for f in FIELDS}
    stats = []
    for f in ("fprice", "distance", "rating"):
        lst = lists[f]
        mean = (f"CASE WHEN list_count({lst}) < len({lst}) THEN NULL "
                f"ELSE COALESCE(list_sum({lst}), 0) / (len({lst}) + 1e-8) END")
        std = (f"CASE WHEN ({mean}) IS NULL THEN NULL ELSE sqrt(COALESCE(list_sum(list_transform({lst}, "
               f"lambda x: (x - ({mean})) * (x - ({mean})))), 0) / (len({lst}) + 1e-8)) END")
        stats += [f"{mean} AS clicked_{f}_list_10", f"{std} AS clicked_{f}_list_10_std"]
    share = ("CASE WHEN {v} IS NULL OR h IS NULL THEN NULL ELSE "
             "len(list_filter({l}, lambda x: x = {v})) / (len(h) + 1e-8) END")
    ratio = ", ".join(f"CASE WHEN avg({c}) OVER (PARTITION BY requestid) = 0 THEN NULL "
                      f"ELSE {c} / avg({c}) OVER (PARTITION BY requestid) END AS {c}_ratio"
                      for c in ("fprice", "rating", "distance", "discount_per"))
    ranks = ", ".join(f"ceil({i / 10} * n)" for i in range(1, 10))
    pos_ids = ", ".join(f"COALESCE(k.ki[{i}], 0) AS clicked_itemid_{i}" for i in range(1, 11))
    pos_types = ", ".join(f"COALESCE(k.kt[{i}], 0) AS clicked_item_type_{i}" for i in range(1, 11))
    body = _upto_b6() + f""",
b7 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY itemid, requestid
         ORDER BY {TARGET_RANK}, {_nf(rest)}) AS rn FROM b6) WHERE rn = 1),
b8 AS (SELECT b7.* EXCLUDE (h), {lists['itemid']} AS clicked_itemid_list_10,
              {lists['item_type']} AS clicked_item_type_list_10,
              {share.format(v='itemid', l=lists['itemid'])} AS item_clicked_rate,
              {share.format(v='item_type', l=lists['item_type'])} AS cat_clicked_rate,
              {', '.join(stats)} FROM b7),
b9 AS (SELECT *, {ratio} FROM b8),
vals AS (SELECT distance AS x FROM b9 WHERE distance IS NOT NULL AND NOT isnan(distance)),
cnt AS (SELECT count(*) AS n FROM vals),
qs AS (SELECT DISTINCT x AS q FROM (SELECT x, row_number() OVER (ORDER BY x) AS rn FROM vals), cnt WHERE rn IN ({ranks})),
b10 AS (SELECT *, CAST(CASE WHEN distance IS NULL THEN NULL ELSE (SELECT count(*) FROM qs WHERE q <= distance) END
                       AS DOUBLE) AS distance_buckets FROM b9),
req AS (SELECT requestid, cityid, any_value(clicked_itemid_list_10) AS ids,
               any_value(clicked_item_type_list_10) AS types FROM b10 GROUP BY requestid, cityid),
vi AS (SELECT DISTINCT itemid AS v, cityid AS c FROM b10),
vt AS (SELECT DISTINCT item_type AS v, cityid AS c FROM b10),
xi AS (SELECT requestid, cityid, unnest(ids) AS v, generate_subscripts(ids, 1) AS p FROM req),
xt AS (SELECT requestid, cityid, unnest(types) AS v, generate_subscripts(types, 1) AS p FROM req),
ki AS (SELECT x.requestid, x.cityid, list(CASE WHEN vi.v IS NOT NULL THEN x.v ELSE 0 END ORDER BY x.p) AS ki
         FROM xi x LEFT JOIN vi ON vi.v = x.v AND vi.c = x.cityid GROUP BY x.requestid, x.cityid),
kt AS (SELECT x.requestid, x.cityid, list(CASE WHEN vt.v IS NOT NULL THEN x.v ELSE 0 END ORDER BY x.p) AS kt
         FROM xt x LEFT JOIN vt ON vt.v = x.v AND vt.c = x.cityid GROUP BY x.requestid, x.cityid),
k AS (SELECT req.requestid AS rq, req.cityid AS rc, COALESCE(ki.ki, []) AS ki, COALESCE(kt.kt, []) AS kt FROM req
        LEFT JOIN ki ON ki.requestid = req.requestid AND ki.cityid IS NOT DISTINCT FROM req.cityid
        LEFT JOIN kt ON kt.requestid = req.requestid AND kt.cityid IS NOT DISTINCT FROM req.cityid)
SELECT b10.* EXCLUDE (clicked_itemid_list_10, clicked_item_type_list_10), {pos_ids}, {pos_types}
  FROM b10 LEFT JOIN k ON k.rq = b10.requestid AND k.rc IS NOT DISTINCT FROM b10.cityid"""
    return duck_with(VIEWS, body)


def z_columns() -> str:
    """z-scores of the 36 numerics over the rows at hand, flags, one-hots."""
    from ..operators.encode import FLAG_FEATURES, NEAR_MEAN, NUMERIC_FEATURES, PLATFORMS
    z = ", ".join(f"COALESCE(CASE WHEN stddev_samp({c}) OVER () = 0 THEN NULL "
                  f"WHEN abs({c} - avg({c}) OVER ()) <= {NEAR_MEAN} * abs(avg({c}) OVER ()) THEN 0 "
                  f"ELSE ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END, 0) AS {c}"
                  for c in NUMERIC_FEATURES)
    flags = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in FLAG_FEATURES)
    hot = ", ".join(f"CASE WHEN platform = '{p}' THEN 1 ELSE 0 END AS {p}" for p in PLATFORMS)
    return f"{z}, {flags}, {hot}"


def model_input_sql(sample_dir: str) -> str:
    return f"SELECT requestid, itemid, {z_columns()} FROM (\n{full_sql(sample_dir)}\n) AS f"


def assemble_sql(sample_dir: str) -> str:
    from ..operators.encode import model_input_columns
    cols = ", ".join(f"CAST({c} AS DOUBLE)" for c in model_input_columns())
    from .registry import sql_by_position
    return sql_by_position(f"SELECT requestid, itemid, [{cols}] AS features FROM (\n{model_input_sql(sample_dir)}\n) AS m",
                           "features", "requestid", "itemid")
