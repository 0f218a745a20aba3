"""Checked queries: daily counts, rolling weighted rates, dense grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck_with, view
from ..operators import rates as R
from .registry import finish, register


def _daily_sql(keys: list[str], src: str = "timed_event") -> str:
    k = ", ".join(keys)
    return f"""SELECT searchdate, {k},
       CAST(SUM(CASE WHEN event = 'booking' THEN 1 ELSE 0 END) AS BIGINT) AS booking_count,
       CAST(SUM(CASE WHEN event = 'hotel_details_page' THEN 1 ELSE 0 END) AS BIGINT) AS details_count,
       COUNT(fprice) AS impression_count
  FROM {src} GROUP BY searchdate, {k}"""


def rates_ctes(keys: list[str], prefix: str, days: int = 7, z: float = 1.282, src: str = "timed_event",
               dense: bool = False) -> str:
    """CTEs ending in ``{prefix}_rates``: self-join each (key, day j) to the
    key's days i in [j-6, j] (the textbook weighted sums)."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    ak = ", ".join(f"a.{c}" for c in keys)
    pk = ", ".join(f"p.{c}" for c in keys)
    rates = ", ".join(f"m_{r} - {z} * sqrt(v_{r}) / S AS {prefix}_{r}" for r in R.RATES)
    means = ", ".join(f"SUM(w * {r}) / S AS m_{r}" for r in R.RATES)
    spreads = ", ".join(
        f"SUM(p.w * CASE WHEN p.{r} <> 0 THEN (p.{r} - m.m_{r}) * (p.{r} - m.m_{r}) ELSE 0 END) AS v_{r}"
        for r in R.RATES)
    P = prefix
    src_r = f"{P}_r"
    dense_cte = ""
    if dense:
        dense_cte = f"""{P}_g AS (SELECT k.*, d.searchdate, d.di, COALESCE(r.ctr, 0) AS ctr, COALESCE(r.br, 0) AS br,
                 COALESCE(r.dtob, 0) AS dtob
            FROM (SELECT DISTINCT {k} FROM {P}_r) k CROSS JOIN {P}_dates d
            LEFT JOIN {P}_r r ON {" AND ".join(f"r.{c} = k.{c}" for c in keys)} AND r.di = d.di),"""
        src_r = f"{P}_g"
    return f"""{P}_daily AS ({_daily_sql(keys, src)}),
{P}_dates AS (SELECT searchdate, dense_rank() OVER (ORDER BY searchdate) - 1 AS di
            FROM (SELECT DISTINCT searchdate FROM {P}_daily WHERE searchdate IS NOT NULL)),
{P}_r AS (SELECT {k}, d.searchdate, di,
                 CASE WHEN impression_count = 0 THEN 0 ELSE details_count / impression_count END AS ctr,
                 CASE WHEN impression_count = 0 THEN 0 ELSE booking_count / impression_count END AS br,
                 CASE WHEN details_count = 0 THEN 0 ELSE booking_count / details_count END AS dtob
            FROM {P}_daily d JOIN {P}_dates USING (searchdate) WHERE {nn}),
{dense_cte}
{P}_pairs AS (SELECT {ak}, a.searchdate, a.di AS j, {days} - (a.di - b.di) AS w,
                 b.ctr, b.br, b.dtob,
                 CAST({days} * (LEAST(a.di, {days - 1}) + 1)
                      - (LEAST(a.di, {days - 1}) + 1) * LEAST(a.di, {days - 1}) / 2 AS DOUBLE) AS S
            FROM {src_r} a JOIN {src_r} b ON {on} AND b.di BETWEEN a.di - {days - 1} AND a.di),
{P}_m AS (SELECT {k}, j, searchdate, S, {means} FROM {P}_pairs GROUP BY {k}, j, searchdate, S),
{P}_v AS (SELECT {pk}, p.j, {spreads} FROM {P}_pairs p JOIN {P}_m m USING ({k}, j) GROUP BY {pk}, p.j),
{P}_rates AS (SELECT {k}, searchdate, {rates} FROM {P}_m JOIN {P}_v USING ({k}, j))"""


def rates_oracle(keys: list[str], prefix: str, days: int = 7, z: float = 1.282) -> str:
    return duck_with(["timed_event"], f", {rates_ctes(keys, prefix, days, z)}\nSELECT * FROM {prefix}_rates")


def _daily(spark, sf, keys):
    return R.daily_counts(view(spark, sf, "timed_event"), keys)


register("agg_daily_counts",
         duck_with(["timed_event"], _daily_sql(["itemid"])))(
    lambda spark, sf: finish(_daily(spark, sf, ["itemid"])))


def _rates(keys, prefix):
    def q(spark, sf):
        return finish(R.weighted_rates(view(spark, sf, "timed_event"), keys, prefix=prefix))
    return q


register("win_rates_item", rates_oracle(["itemid"], "item"))(_rates(["itemid"], "item"))
register("win_rates_item_place", rates_oracle(["itemid", "placeid"], "item_place"))(
    _rates(["itemid", "placeid"], "item_place"))
register("win_rates_user_cat", rates_oracle(["userid", "display_category"], "user_cat"))(
    _rates(["userid", "display_category"], "user_cat"))


DAILY_RATES = """SELECT searchdate, itemid,
       CASE WHEN impression_count = 0 THEN 0 ELSE details_count / impression_count END AS raw_ctr,
       CASE WHEN impression_count = 0 THEN 0 ELSE booking_count / impression_count END AS raw_br,
       CASE WHEN details_count = 0 THEN 0 ELSE booking_count / details_count END AS raw_dtob
  FROM (""" + _daily_sql(["itemid"]) + ")"


def _daily_rates(spark, sf):
    return R.daily_rates(_daily(spark, sf, ["itemid"]), ["itemid"])


@register("agg_series", duck_with(["timed_event"], f""", d AS ({DAILY_RATES})
SELECT itemid, list(searchdate ORDER BY searchdate) AS days, list(raw_ctr ORDER BY searchdate) AS ctrs FROM d GROUP BY itemid"""))
def q_series(spark, sf):
    s = R.series(_daily_rates(spark, sf), ["itemid"], value="raw_ctr")
    return finish(s.select("itemid", F.col("series")["day"].alias("days"), F.col("series")["v"].alias("ctrs")))


@register("fn_zip_explode", duck_with(["timed_event"], f", d AS ({DAILY_RATES})\nSELECT itemid, searchdate, raw_ctr FROM d"))
def q_zip_explode(spark, sf):
    from ..functions.vectors import zip_explode
    s = R.series(_daily_rates(spark, sf), ["itemid"], value="raw_ctr")
    s = s.select("itemid", F.col("series")["day"].alias("days"), F.col("series")["v"].alias("ctrs"))
    return finish(zip_explode(s, ["itemid"], {"searchdate": "days", "raw_ctr": "ctrs"}))


@register("join_densify", duck_with(["timed_event"], f""", d AS ({DAILY_RATES})
SELECT k.itemid, t.searchdate, COALESCE(d.raw_ctr, 0) AS raw_ctr, COALESCE(d.raw_br, 0) AS raw_br,
       COALESCE(d.raw_dtob, 0) AS raw_dtob
  FROM (SELECT DISTINCT itemid FROM d) k CROSS JOIN (SELECT DISTINCT searchdate FROM d) t
  LEFT JOIN d ON d.itemid = k.itemid AND d.searchdate = t.searchdate"""))
def q_densify(spark, sf):
    return finish(R.densify(_daily_rates(spark, sf), ["itemid"]))


@register("win_weighted_lower_bound", duck_with(["timed_event"], f", {rates_ctes(['itemid'], 'item', dense=True)}\n"
                                                                  "SELECT * FROM item_rates"))
def q_dense_bound(spark, sf):
    """The rolling bound evaluated on the dense key x date grid."""
    dense = R.densify(_daily_rates(spark, sf), ["itemid"])
    idx = R.date_index(dense)
    out = R.rolling_lower_bound(dense.join(F.broadcast(idx), "searchdate"), ["itemid"], "_di",
                                ["raw_ctr", "raw_br", "raw_dtob"])
    return finish(out.select("itemid", "searchdate", *[F.col(f"raw_{r}_lb").alias(f"item_{r}") for r in R.RATES]))


RATE_SETS = {"item": ["itemid"], "item_place": ["itemid", "placeid"], "user_cat": ["userid", "display_category"]}


def _joined_rates_sql(select: str) -> str:
    ctes = ",\n".join(rates_ctes(k, p) for p, k in RATE_SETS.items())
    joins = " ".join(f"LEFT JOIN {p}_rates USING ({', '.join(k)}, searchdate)" for p, k in RATE_SETS.items())
    return duck_with(["timed_event"], f", {ctes}\nSELECT {select} FROM timed_event t {joins}")


def _joined_rates(spark, sf):
    te = view(spark, sf, "timed_event")
    df = te
    for p, k in RATE_SETS.items():
        df = df.join(R.weighted_rates(te, k, prefix=p), on=[*k, "searchdate"], how="left")
    return df


ALL_RATE_COLS = [f"{p}_{r}" for p in RATE_SETS for r in R.RATES]


@register("join_rates", _joined_rates_sql("event_id, " + ", ".join(ALL_RATE_COLS)))
def q_join_rates(spark, sf):
    return finish(_joined_rates(spark, sf).select("event_id", *ALL_RATE_COLS))


@register("fn_rate_fallback", _joined_rates_sql("event_id, " + ", ".join(
    f"CASE WHEN distance IS NULL AND placeid IS NULL THEN item_{r} ELSE item_place_{r} END AS item_place_{r}"
    for r in R.RATES)))
def q_rate_fallback(spark, sf):
    from ..functions.flags import fallback
    df = _joined_rates(spark, sf)
    cond = F.col("distance").isNull() & F.col("placeid").isNull()
    return finish(df.select("event_id", *[fallback(cond, f"item_{r}", f"item_place_{r}").alias(f"item_place_{r}")
                                          for r in R.RATES]))
