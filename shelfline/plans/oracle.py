"""The same queries as plain SQL for another engine, over the raw sample tables.

Written from the definitions, not from the Spark plans: the as-coded mart joins
at line grain and the replay rebuilds everything per date.  Flags are counted
with CASE sums, ratios divide doubles once and are not rounded.  The potential
low-stock impact is summed in whole millionths, each day rounded half up.
"""

from __future__ import annotations

from shelfline.sources.schemas import varchar_limits

AS_OF = "date '1998-09-02'"
REPLAY = "(values (date '1996-06-30'), (date '1998-09-02'), (date '2000-12-31')) d(as_of)"

SALES = """
placed as (
  select l.*, n_regionkey as store_key, cast(substr(p_brand, 7) as integer) as prod_key,
         p_retailprice
  from lineitem l
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
  join part on l_partkey = p_partkey
),
priced as (
  select l_orderkey as trans_id, prod_key, store_key, cast(l_shipdate as date) as trans_dt,
         l_linenumber as trans_time,
         cast(l_quantity as decimal(18,2)) as sales_qty,
         cast(p_retailprice as decimal(18,2)) as sales_price,
         cast(l_extendedprice as decimal(18,2)) as sales_amt,
         cast(l_discount as decimal(4,2)) as discount_rate,
         cast(l_tax as decimal(4,2)) as ship_rate
  from placed
),
sales as (
  select trans_id, prod_key, store_key, trans_dt, trans_time, sales_qty, sales_price, sales_amt,
         cast(sales_amt * discount_rate as decimal(18,2)) as discount,
         cast(sales_price * sales_qty as decimal(18,2)) as sales_cost,
         cast(sales_amt - cast(sales_price * sales_qty as decimal(18,2)) as decimal(18,2))
           as sales_mgrn,
         cast(sales_amt * ship_rate as decimal(18,2)) as ship_cost
  from priced
)"""

STOCK = """
inventory as (
  select cast(o_orderdate as date) as cal_dt, store_key, prod_key,
         sum(case when l_linestatus = 'F' then cast(l_quantity as decimal(18,2)) else 0 end)
           as inventory_on_hand_qty,
         sum(cast(l_quantity as decimal(18,2))) as inventory_on_order_qty,
         sum(case when l_linestatus = 'F' then 1 else 0 end) = 0 as out_of_stock_flg,
         sum(case when l_returnflag = 'R' then cast(l_quantity as decimal(18,2)) else 0 end)
           as waste_qty,
         max(cast(l_discount as decimal(4,2))) > 0.05 as promotion_flg,
         cast(max(l_shipdate) as date) as next_delivery_dt
  from placed join orders on l_orderkey = o_orderkey
  group by 1, 2, 3
)"""

CALENDAR = """
calendar as (
  select cal_dt, isoyear(cal_dt) as yr_num, week(cal_dt) as wk_num,
         isodow(cal_dt) - 1 as day_of_wk_num
  from (select cast(d as date) as cal_dt
        from (select least(min(l_shipdate), (select min(o_orderdate) from orders)) as lo,
                     greatest(max(l_shipdate), (select max(o_orderdate) from orders)) as hi
              from lineitem),
             generate_series(date_trunc('day', lo), date_trunc('day', hi), interval 1 day) g(d))
)"""

DAILY = """
sold as (
  select trans_dt, store_key, prod_key, sum(sales_qty) as sales_qty,
         sum(sales_price) as price_total, count(sales_price) as price_lines,
         sum(sales_amt) as sales_amt, sum(discount) as discount, sum(sales_cost) as sales_cost,
         sum(sales_mgrn) as sales_mgrn
  from sales group by 1, 2, 3
),
daily as (
  select coalesce(s.trans_dt, i.cal_dt) as trans_dt,
         coalesce(s.store_key, i.store_key) as store_key,
         coalesce(s.prod_key, i.prod_key) as prod_key,
         sales_qty, price_total, price_lines, sales_amt, discount, sales_cost, sales_mgrn,
         inventory_on_hand_qty, inventory_on_order_qty, out_of_stock_flg,
         not out_of_stock_flg as in_stock_flg,
         case when inventory_on_hand_qty is null then null
              else coalesce(inventory_on_hand_qty < sales_qty, false) end as low_stock_flg
  from sold s full outer join inventory i
    on s.trans_dt = i.cal_dt and s.store_key = i.store_key and s.prod_key = i.prod_key
)"""


def _metrics(days: str, keys: str) -> str:
    """The weekly metrics over day rows ``days`` that carry ``keys`` and the weekday."""
    return f"""
sums as (
  select {keys},
         cast(coalesce(sum(sales_qty), 0) as double) as wk_sales_qty,
         cast(coalesce(sum(sales_amt), 0) as double) as wk_sales_amt,
         cast(coalesce(sum(discount), 0) as double) as wk_discount,
         cast(coalesce(sum(sales_cost), 0) as double) as wk_sales_cost,
         cast(coalesce(sum(sales_mgrn), 0) as double) as wk_sales_mgrn,
         cast(sum(price_total) as double) / nullif(cast(sum(price_lines) as double), 0)
           as mean_line_price,
         cast(sum(case when day_of_wk_num = 6 then inventory_on_hand_qty end) as double)
           as eop_stock_on_hand_qty,
         cast(sum(case when day_of_wk_num = 6 then inventory_on_order_qty end) as double)
           as eop_ordered_stock_qty,
         cast(sum(case when out_of_stock_flg then 1 else 0 end) as bigint) as out_of_stock_times,
         cast(sum(case when in_stock_flg then 1 else 0 end) as bigint) as in_stock_times,
         cast(sum(case when low_stock_flg then 1 else 0 end) as bigint) as low_stock_times,
         count(out_of_stock_flg) as known_days,
         cast(sum(case when out_of_stock_flg is null and low_stock_flg is null then null
                       else coalesce(cast(out_of_stock_flg as integer), 0)
                            + coalesce(cast(low_stock_flg as integer), 0) end) as bigint)
           as low_stock_impact,
         cast(sum(case when low_stock_flg then
             (20000 * cast(sales_amt * 100 as hugeint)
                * cast((sales_qty - inventory_on_hand_qty) * 100 as hugeint)
              + cast(sales_qty * 100 as hugeint))
             // (2 * cast(sales_qty * 100 as hugeint)) end) as double) / 1000000
           as potential_low_stock_impact,
         cast(sum(case when out_of_stock_flg then sales_amt end) as double) as no_stock_impact
  from {days}
  group by {keys}
),
mart as (
  select {keys}, wk_sales_qty, wk_sales_amt / nullif(wk_sales_qty, 0) as avg_sales_price,
         mean_line_price, wk_sales_amt, wk_discount, wk_sales_cost, wk_sales_mgrn,
         eop_stock_on_hand_qty, eop_ordered_stock_qty,
         out_of_stock_times, in_stock_times, low_stock_times,
         cast(out_of_stock_times as double) / 7 as out_of_stock_pct,
         case when known_days > 0 then 1 - cast(out_of_stock_times as double) / 7 end
           as in_stock_pct,
         low_stock_impact, potential_low_stock_impact, no_stock_impact,
         eop_stock_on_hand_qty / nullif(wk_sales_qty, 0) as weeks_of_supply
  from sums
)"""


WEEK_KEYS = "yr_num, wk_num, store_key, prod_key"
KEYS = ", ".join(f"cast({k} as bigint) as {k}" for k in WEEK_KEYS.split(", "))
CELL_KEYS = "cast(store_key as bigint) as store_key, cast(prod_key as bigint) as prod_key"
DATED = """
dated as (select * from daily join calendar on trans_dt = cal_dt)"""

_LINES = f"with {SALES}"
_STOCK = f"with {SALES},{STOCK}"
_DAILY = f"with {SALES},{STOCK},{DAILY}"
_MART = f"with {SALES},{STOCK},{CALENDAR},{DAILY},{DATED},{_metrics('dated', WEEK_KEYS)}"
_AS_OF_MART = _MART.replace(
    "from daily join calendar on trans_dt = cal_dt)",
    f"from daily join calendar on trans_dt = cal_dt where trans_dt <= {AS_OF})",
)
_REPLAY = (
    f"with {SALES},{STOCK},{CALENDAR},{DAILY},\n"
    "dated as (select * from daily join calendar on trans_dt = cal_dt "
    f"join {REPLAY} on trans_dt <= as_of),"
    f"{_metrics('dated', 'as_of, ' + WEEK_KEYS)}"
)

MART_COLUMNS = (
    "wk_sales_qty, avg_sales_price, mean_line_price, wk_sales_amt, wk_discount, wk_sales_cost, "
    "wk_sales_mgrn, eop_stock_on_hand_qty, eop_ordered_stock_qty, out_of_stock_times, "
    "in_stock_times, low_stock_times, out_of_stock_pct, in_stock_pct, low_stock_impact, "
    "potential_low_stock_impact, no_stock_impact, weeks_of_supply"
)

STOCK_ROW = f"""cal_dt, {CELL_KEYS},
       cast(inventory_on_hand_qty as double) as inventory_on_hand_qty,
       cast(inventory_on_order_qty as double) as inventory_on_order_qty,
       out_of_stock_flg, cast(waste_qty as double) as waste_qty, promotion_flg, next_delivery_dt"""

SALES_ROW = f"""trans_id, trans_dt, {CELL_KEYS}, cast(trans_time as bigint) as trans_time,
       cast(sales_qty as double) as sales_qty, cast(sales_price as double) as sales_price,
       cast(sales_amt as double) as sales_amt, cast(discount as double) as discount,
       cast(sales_cost as double) as sales_cost, cast(sales_mgrn as double) as sales_mgrn,
       cast(ship_cost as double) as ship_cost"""

DAY_ROW = f"""trans_dt, {CELL_KEYS},
       cast(sales_qty as double) as sales_qty,
       cast(price_total as double) / nullif(cast(price_lines as double), 0) as sales_price,
       cast(sales_amt as double) as sales_amt, cast(discount as double) as discount,
       cast(sales_cost as double) as sales_cost, cast(sales_mgrn as double) as sales_mgrn,
       cast(inventory_on_hand_qty as double) as inventory_on_hand_qty,
       cast(inventory_on_order_qty as double) as inventory_on_order_qty,
       out_of_stock_flg, in_stock_flg, low_stock_flg"""

NAMES = """
listing as (
  select case when rank = '5' and o_orderstatus = 'P' then 'returns'
              when rank = '1' then 'sales' when rank = '2' then 'inventory'
              when rank = '3' then 'product' when rank = '4' then 'store'
              when rank = '5' then 'calendar' end as table_name,
         run_date, o_orderstatus = 'O' as dashed
  from (select substr(o_orderpriority, 1, 1) as rank, o_orderstatus,
               cast(o_orderdate as date) as run_date from orders)
  union all
  select case event_type when 'click' then 'sales' when 'error' then 'inventory'
              when 'purchase' then 'product' when 'signup' then 'store'
              when 'view' then 'calendar' else 'returns' end,
         cast(ts as date), false
  from events
),
found as (
  select run_date, table_name,
         max(case when dashed then table_name || '_' || strftime(run_date, '%Y-%m-%d') || '.csv'
                  else table_name || '_' || strftime(run_date, '%Y%m%d') || '.csv.gz' end) as name
  from listing group by 1, 2
),
required(table_name) as (values ('sales'), ('inventory'), ('product'), ('store'), ('calendar')),
expected as (select run_date, table_name
             from (select distinct run_date from found) cross join required),
ready as (
  select run_date from found group by 1
  having count(*) = 5 and sum(case when table_name = 'returns' then 1 else 0 end) = 0
)"""


def _mart(columns: str = MART_COLUMNS) -> str:
    return f"{_MART}\nselect {KEYS}, {columns} from mart"


SQL: dict[str, str] = {
    "m01_m02_weekly_sales": f"""with {SALES},{CALENDAR}
select {KEYS}, cast(sum(sales_qty) as double) as wk_sales_qty,
       cast(sum(sales_amt) as double) as wk_sales_amt
from sales join calendar on trans_dt = cal_dt
group by {WEEK_KEYS} order by {WEEK_KEYS}""",
    "m_weekly_mart": _mart(),
    "m03_avg_price": _mart("avg_sales_price, mean_line_price"),
    "m04_m05_end_of_week": _mart("eop_stock_on_hand_qty, eop_ordered_stock_qty"),
    "m06_total_cost": _mart("wk_sales_cost, wk_discount, wk_sales_mgrn"),
    "m07_stock_pct": _mart("out_of_stock_pct, in_stock_pct"),
    "m08_m10_impacts": _mart("low_stock_impact, potential_low_stock_impact, no_stock_impact"),
    "m11_m12_instances": _mart("low_stock_times, out_of_stock_times, in_stock_times"),
    "m13_weeks_of_supply": _mart("weeks_of_supply"),
    "a_weekly_mart_compat": f"""with {SALES},{STOCK},{CALENDAR},
paired as (
  select s.*, i.inventory_on_hand_qty, i.inventory_on_order_qty, i.out_of_stock_flg
  from sales s full outer join inventory i
    on s.trans_dt = i.cal_dt and s.store_key = i.store_key and s.prod_key = i.prod_key
)
select {KEYS}, cast(sum(sales_qty) as double) as wk_sales_qty,
       cast(sum(sales_price) as double) / count(sales_price) as avg_sales_price,
       cast(sum(sales_amt) as double) as wk_sales_amt,
       cast(sum(discount) as double) as wk_discount,
       cast(sum(sales_cost) as double) as wk_sales_cost,
       cast(sum(sales_mgrn) as double) as wk_sales_mgrn,
       cast(sum(case when day_of_wk_num = 6 then inventory_on_hand_qty else 0 end) as double)
         as eop_stock_on_hand_qty,
       cast(sum(case when day_of_wk_num = 6 then inventory_on_order_qty else 0 end) as double)
         as eop_ordered_stock_qty,
       count(*) as out_of_stock_times, count(*) as in_stock_times, count(*) as low_stock_times
from paired join calendar on trans_dt = cal_dt
group by {WEEK_KEYS}""",
    "a13_inventory_by_weekday": f"""{_STOCK},{CALENDAR}
select {CELL_KEYS}, cast(day_of_wk_num as bigint) as day_of_wk_num,
       cast(sum(inventory_on_hand_qty) as double) as sum_inventory_on_hand_qty,
       cast(sum(inventory_on_order_qty) as double) as sum_inventory_on_order_qty,
       cast(sum(case when out_of_stock_flg then 1 else 0 end) as bigint) as low_stock_impact,
       cast(sum(case when out_of_stock_flg then 1 else 0 end) as double) / 7
         as percentage_in_stock
from inventory i join calendar c on i.cal_dt = c.cal_dt
group by store_key, prod_key, day_of_wk_num""",
    "a14_sales_by_weekday": f"""{_LINES},{CALENDAR}
select {CELL_KEYS}, cast(day_of_wk_num as bigint) as day_of_wk_num,
       cast(sum(sales_qty) as double) as sum_sales_qty,
       cast(sum(sales_amt) as double) as sum_sales_amt,
       cast(sum(sales_amt) as double) / nullif(cast(sum(sales_qty) as double), 0)
         as average_sales_price,
       cast(sum(sales_cost) as double) as total_cost
from sales join calendar on trans_dt = cal_dt
group by store_key, prod_key, day_of_wk_num""",
    "j01_daily_sales_inventory": f"{_DAILY}\nselect {DAY_ROW} from daily",
    "j03_inventory_calendar": f"""{_STOCK},{CALENDAR}
select i.cal_dt, {KEYS}, cast(day_of_wk_num as bigint) as day_of_wk_num,
       cast(inventory_on_hand_qty as double) as inventory_on_hand_qty
from inventory i join calendar c on i.cal_dt = c.cal_dt""",
    "j04_sales_calendar": f"""{_LINES},{CALENDAR}
select trans_id, trans_dt, {KEYS}, cast(day_of_wk_num as bigint) as day_of_wk_num,
       cast(sales_qty as double) as sales_qty, cast(sales_amt as double) as sales_amt
from sales join calendar on trans_dt = cal_dt""",
    "j05_star_join": f"""{_MART},
product as (select distinct cast(substr(p_brand, 7) as integer) as prod_key,
                   p_brand as brand_name from part)
select cast(yr_num as bigint) as yr_num, cast(wk_num as bigint) as wk_num,
       cast(m.store_key as bigint) as store_key, cast(m.prod_key as bigint) as prod_key,
       r_name as store_desc, brand_name, wk_sales_qty, wk_sales_amt
from mart m left join region on store_key = r_regionkey
            left join product p on m.prod_key = p.prod_key""",
    "j06_missing_unexpected": f"""with {NAMES}
select run_date, table_name, 'missing' as status
from (select * from expected except select run_date, table_name from found)
union all
select run_date, table_name, 'unexpected' as status
from (select run_date, table_name from found except select * from expected)""",
    "p04_p05_stock_flags": f"""{_DAILY}
select trans_dt, {CELL_KEYS}, out_of_stock_flg, in_stock_flg, low_stock_flg,
       case when out_of_stock_flg = true then false else true end as in_stock_flg_as_coded,
       case when inventory_on_hand_qty < sales_qty then true else false end
         as low_stock_flg_as_coded
from daily""",
    "p06_p07_closing_levels": f"""{_STOCK},{CALENDAR}
select i.cal_dt, {CELL_KEYS},
       cast(case when day_of_wk_num = 6 then inventory_on_hand_qty else 0 end as double)
         as closing_on_hand,
       cast(case when out_of_stock_flg = true then 1 else 0 end as bigint) as is_out
from inventory i join calendar c on i.cal_dt = c.cal_dt""",
    "p08_as_of_today": f"""{_STOCK},
moved as (select * replace (cal_dt + cast(date_diff('day', {AS_OF}, current_date) as integer) as cal_dt) from inventory)
select {STOCK_ROW} from moved where cal_dt <= current_date""",
    "p09_as_of_date": f"{_LINES}\nselect {SALES_ROW} from sales where trans_dt <= {AS_OF}",
    "p10_as_of_next_day": f"{_STOCK}\nselect {STOCK_ROW} from inventory where cal_dt <= {AS_OF} + 1",
    "p11_coercion": """
select reject_reason, cast(flag as bigint) as out_of_stock_flg, count(*) as n_rows,
       cast(sum(on_hand) as double) as on_hand, cast(sum(on_order) as double) as on_order
from (
  select case when l_returnflag = 'N' then 'inventory_on_hand_qty'
              when flag = 2 then 'out_of_stock_flg' end as reject_reason,
         flag,
         case when l_returnflag <> 'N' then cast(l_quantity as decimal(18,2)) end as on_hand,
         cast(l_quantity as decimal(18,2)) as on_order
  from (select *, case when l_linestatus = 'F' then 0 when l_returnflag = 'A' then 2
                       when l_returnflag = 'R' then 1 end as flag from lineitem)
) group by 1, 2""",
    "o01_ordered_mart": _mart("wk_sales_qty, wk_sales_amt, eop_stock_on_hand_qty")
    + f"\norder by {WEEK_KEYS}",
    "o02_preview": _mart("wk_sales_qty, wk_sales_amt") + f"\norder by {WEEK_KEYS} limit 20",
    "f02_f06_names_and_dates": """
select o_orderkey, next_day,
       table_name || '_' || strftime(next_day, '%Y%m%d') || '.csv.gz' as compact_name,
       table_name || '_' || strftime(next_day, '%Y-%m-%d') || '.csv' as dashed_name,
       table_name as compact_table, table_name as dashed_table,
       next_day as compact_date, next_day as dashed_date
from (select o_orderkey, cast(o_orderdate as date) + 1 as next_day,
             lower(regexp_replace(o_orderpriority, '[^A-Z]+', '', 'g')) as table_name
      from orders)""",
    "f09_manifest_lookup": f"""with {NAMES}
select run_date,
       max(case when table_name = 'calendar' then 's3a://landing/' || name end) as calendar_path,
       max(case when table_name = 'inventory' then 's3a://landing/' || name end) as inventory_path,
       max(case when table_name = 'product' then 's3a://landing/' || name end) as product_path,
       max(case when table_name = 'sales' then 's3a://landing/' || name end) as sales_path,
       max(case when table_name = 'store' then 's3a://landing/' || name end) as store_path
from found join ready using (run_date) group by run_date""",
    "r01_landing_audit": f"""with {NAMES},
joined as (
  select run_date, coalesce(e.table_name, f.table_name) as table_name,
         e.table_name is not null as wanted, f.table_name is not null as here
  from expected e full outer join found f using (run_date, table_name)
)
select run_date,
       coalesce(string_agg(case when wanted and here then table_name end, ',' order by table_name),
                '') as present,
       coalesce(string_agg(case when not here then table_name end, ',' order by table_name), '')
         as missing,
       cast(sum(case when wanted and here then 1 else 0 end) as bigint) as n_present,
       cast(sum(case when not here then 1 else 0 end) as bigint) as n_missing,
       cast(sum(case when not wanted then 1 else 0 end) as bigint) as n_unexpected,
       sum(case when wanted and here then 0 else 1 end) = 0 as ready
from joined group by run_date""",
    "r01_unrecognised_names": f"""with {NAMES}
select table_name || '_' || strftime(run_date, '%Y') || substr(strftime(run_date, '%m%d'), 2) || '.csv.gz' as name, count(*) as n_files
from listing where not dashed and month(run_date) < 10 group by 1""",
    "r02_as_of_replay": f"{_REPLAY}\nselect as_of, {KEYS}, {MART_COLUMNS} from mart",
    "r03_manifest": f"""with {NAMES}
select run_date,
       '{{"conf":{{' || string_agg('"' || table_name || '":"s3a://landing/' || name || '"', ','
                                   order by table_name) || '}}}}' as payload
from found join ready using (run_date) group by run_date""",
    "r03_continuous_readiness": f"""with {NAMES},
joined as (
  select run_date, coalesce(e.table_name, f.table_name) as table_name,
         e.table_name is not null as wanted, f.table_name is not null as here
  from expected e full outer join found f using (run_date, table_name)
)
select run_date, 'ready' as status,
       '{{"conf":{{' || string_agg('"' || table_name || '":"s3a://landing/' || name || '"', ','
                                   order by table_name) || '}}}}' as payload,
       null as missing, cast(0 as bigint) as n_unexpected
from found join ready using (run_date) group by run_date
union all
select run_date, 'late', null, coalesce(string_agg(case when not here then table_name end, ',' order by table_name), ''),
       cast(sum(case when not wanted then 1 else 0 end) as bigint)
from joined where run_date not in (select run_date from ready) group by run_date""",
    "r04_snapshot_counts": f"""{_STOCK},{CALENDAR}
select 'sales' as table_name, count(*) as rows_written from sales where trans_dt <= {AS_OF}
union all select 'inventory', count(*) from inventory where cal_dt <= {AS_OF}
union all select 'store', count(*) from region
union all select 'product', count(distinct p_brand) from part
union all select 'calendar', count(*) from calendar""",
    "r04_verified_export": f"""{_STOCK},{CALENDAR}
select 'sales' as table_name, count(*) as n_rows, true as loss_refused from sales where trans_dt <= {AS_OF}
union all select 'inventory', count(*), true from inventory where cal_dt <= {AS_OF}
union all select 'store', count(*), true from region
union all select 'product', count(distinct p_brand), true from part
union all select 'calendar', count(*), true from calendar""",
    "s01_typed_csv_roundtrip": f"{_LINES}\nselect {SALES_ROW} from sales",
    "s02_drop_for_a_date": f"""{_STOCK}
select {STOCK_ROW}, dashed_name
from inventory cross join (values (true), (false)) v(dashed_name) where cal_dt <= {AS_OF}""",
    "s03_declared_table_load": f"{_STOCK}\nselect {STOCK_ROW} from inventory",
    "s06_list_files": f"""{_MART}
select distinct cast(yr_num as bigint) as yr_num, cast(wk_num as bigint) as wk_num,
       true as has_data, true as dated from mart""",
    "s08_mart_from_saved_daily": _mart(),
    "s06_listing_history": """
with named as (
  select 's3a://landing/' || regexp_replace(lower(o_orderpriority), '[^a-z]+', '', 'g') || '_'
         || case when o_orderstatus = 'O' then strftime(o_orderdate, '%Y-%m-%d') || '.csv'
                 else strftime(o_orderdate, '%Y%m%d') || '.csv.gz' end as path, * from orders
),
one as (select path, count(*) as length, max(o_orderkey) as seconds from named where o_orderstatus in ('O', 'F') group by path),
two as (select path, count(*) as length, max(o_orderkey) as seconds from named where o_orderstatus in ('F', 'P') group by path)
select cast(1 as bigint) as look, path, 'added' as status, length, seconds from one
union all
select 2, path, case when one.path is null then 'added' when two.path is null then 'removed' else 'rewritten' end,
       coalesce(two.length, one.length), coalesce(two.seconds, one.seconds)
from one full outer join two using (path)
where one.path is null or two.path is null or one.length <> two.length or one.seconds <> two.seconds""",
    "m04_m05_last_levels": f"""{_MART},
recorded as (
  select yr_num, wk_num, store_key, prod_key, max(trans_dt) as week_day,
         arg_max(inventory_on_hand_qty, trans_dt) as on_hand, arg_max(inventory_on_order_qty, trans_dt) as on_order
  from daily join calendar on trans_dt = cal_dt group by {WEEK_KEYS}
),
carried as (
  select *, last_value(on_hand ignore nulls) over (partition by store_key, prod_key order by yr_num, wk_num) as last_on_hand,
         last_value(on_order ignore nulls) over (partition by store_key, prod_key order by yr_num, wk_num) as last_on_order
  from recorded
)
select {KEYS}, eop_stock_on_hand_qty, eop_ordered_stock_qty,
       cast(last_on_hand as double) as last_on_hand_qty, cast(last_on_order as double) as last_on_order_qty
from mart join carried using (yr_num, wk_num, store_key, prod_key)""",
    "s09_views_in_sql": f"""with {SALES},{CALENDAR}
select {KEYS}, cast(sum(sales_qty) as double) as wk_sales_qty,
       cast(sum(sales_amt) as double) as wk_sales_amt
from sales join calendar on trans_dt = cal_dt group by {WEEK_KEYS}""",
    "s10_external_table": f"""{_MART}
select cast(yr_num as bigint) as yr_num, cast(store_key as bigint) as store_key,
       count(*) as n_rows, sum(wk_sales_qty) as qty,
       cast(sum(cast(wk_sales_amt as decimal(18,2))) as double) as amt,
       cast(sum(out_of_stock_times) as bigint) as out_of_stock_times
from mart group by yr_num, store_key""",
    "s11_contract_breaches": """
select column_name, 'at most ' || n || ' characters' as rule,
       (select cast(sum(case when column_name in ('store_num', 'postal_zip_cd')
                                  and length(c_name) > n then 1
                             when column_name = 'prov_state_desc'
                                  and length(c_name || ' ' || c_mktsegment) > n then 1
                             when column_name = 'market_name'
                                  and length(c_mktsegment) > n then 1
                             else 0 end) as bigint) from customer) as n_rows
from (values ('store_num', 30), ('store_desc', 150), ('addr', 500), ('city', 50),
             ('region', 100), ('cntry_cd', 30), ('cntry_nm', 150), ('postal_zip_cd', 10),
             ('prov_state_desc', 30), ('prov_state_cd', 30), ('store_type_cd', 30),
             ('store_type_desc', 150), ('market_name', 150), ('submarket_name', 150)
     ) v(column_name, n)""",
    "s11_repeated_keys": f"""{_LINES}
select trans_dt, {CELL_KEYS}, count(*) as n_rows
from sales group by trans_dt, sales.store_key, sales.prod_key having count(*) > 1""",
    "s12_job_run": f"{_AS_OF_MART}\nselect {KEYS}, {MART_COLUMNS} from mart",
    "s12_arrivals": f"""{_STOCK}
select run_date, count(*) as n_rows, cast(sum(inventory_on_hand_qty) as double) as on_hand,
       max(cal_dt) as last_cal_dt
from inventory join (values ({AS_OF}), ({AS_OF} + 1)) v(run_date) on cal_dt <= run_date
group by run_date""",
    "k01_parquet_roundtrip": _mart(),
    "k02_daily_roundtrip": f"{_DAILY}\nselect {DAY_ROW} from daily",
    "k03_gzip_unload": f"{_STOCK}\nselect {STOCK_ROW} from inventory",
    "k04_plain_unload": f"{_LINES}\nselect {SALES_ROW} from sales",
    "k05_bounded_parts": f"""{_STOCK}
select count(*) as n_rows, true as bounded, true as enough_parts from inventory""",
    "k01_rerun_smaller": _mart() + " where wk_num <= 26",
    "k02_raw_sales": f"{_LINES}\nselect {SALES_ROW} from sales",
    "s12_append_daily": f"""{_AS_OF_MART}
select {KEYS}, cast(2 as bigint) as n_rows, 2 * wk_sales_qty as qty, 2 * wk_sales_amt as amt from mart""",
    "p11_job_rejects": f"""with {SALES},
raw as (
  select *, case when l_linestatus = 'F' then 0 when l_returnflag = 'A' then 2
                 when l_returnflag = 'R' then 1 end as flag from lineitem
),
judged as (
  select case when l_returnflag = 'N' then 'inventory_on_hand_qty'
              when flag = 2 then 'out_of_stock_flg' end as reject_reason, * from raw
)
select 'inventory' as table_name, reject_reason, count(*) as n_rows
from judged where reject_reason is not null group by reject_reason
union all
select 'inventory', 'repeated key', count(*)
from (select 1 from judged where reject_reason is null
      group by cast(l_shipdate as date), l_suppkey, l_partkey having count(*) > 1)""",
    "p11_malformed_lines": f"""with raw as (
  select l_linenumber as nth, l_quantity, cast(l_shipdate as date) as d, l_suppkey, l_partkey,
         case when l_returnflag = 'N' then 'many' else cast(l_quantity as varchar) end as on_hand,
         case when l_linestatus = 'F' then 0 when l_returnflag = 'A' then 2 when l_returnflag = 'R' then 1 end as flag
  from lineitem
),
lines as (
  select *, concat_ws(',', d, l_suppkey, l_partkey) as key,
         concat_ws(',', on_hand, l_quantity, coalesce(cast(flag as varchar), ''), '') as rest
  from raw
),
judged as (
  select *, case when nth = 7 then 'too few fields' when nth = 6 then 'too many fields' when nth = 5 then 'unclosed quote'
                 when nth = 4 then 'undecodable bytes' when on_hand = 'many' then 'inventory_on_hand_qty'
                 when flag = 2 then 'out_of_stock_flg' end as reject_reason,
         case when nth = 7 then key when nth = 6 then key || ',' || rest || ',true,,,'
              when nth = 5 then key || ',' || rest || ',"true,' when nth = 4 then key || ',' || rest || ',true,?'
              else key || ',' || rest || ',true,' end as line
  from lines
)
select 'inventory' as table_name, reject_reason, count(*) as n_rows, cast(sum(length(line)) as bigint) as n_chars
from judged where reject_reason is not null group by reject_reason
union all
select 'sales_inv_store_dy', null, count(*), cast(sum(q) as bigint)
from (select max(struct_pack(a := cast(on_hand as double), b := l_quantity)).b as q
      from judged where reject_reason is null group by d, l_suppkey, l_partkey)""",
    "p11_repeated_dimension_rejects": f"""with {CALENDAR}
select 'repeated key' as reject_reason, 'calendar' as table_name, count(*) as n_rows from calendar
union all select 'repeated key', 'product', count(distinct p_brand) from part
union all select 'repeated key', 'store', count(*) from region""",
    "j02_repeated_dimension_keys": f"{_AS_OF_MART}\nselect {KEYS}, {MART_COLUMNS} from mart",
    "j01_conflicting_stock": f"""with {SALES},
lines as (
  select cast(o_orderdate as date) as trans_dt, store_key, prod_key,
         case when trans_time % 2 = 0 then sales_qty else 0 end as on_hand, sales_qty as on_order,
         case when trans_time <> 3 then trans_time % 2 = 1 end as flag
  from sales join orders on trans_id = o_orderkey
)
select trans_dt, {CELL_KEYS}, cast(on_hand as double) as inventory_on_hand_qty,
       cast(on_order as double) as inventory_on_order_qty, flag as out_of_stock_flg
from (select *, row_number() over (partition by trans_dt, store_key, prod_key
                                   order by on_hand desc, on_order desc, flag desc nulls last) as nth
      from lines)
where nth = 1""",
    "j02_undated_facts": f"""{_STOCK}
select 'sales' as table_name, count(*) as n_rows from sales where trans_dt > {AS_OF}
union all select 'inventory', count(*) from inventory where cal_dt > {AS_OF}""",
    "s10_dimension_tables": f"""{_AS_OF_MART}
select r_name as store_desc, brand_name, cast(m.yr_num as bigint) as yr_num,
       cast(m.wk_num as bigint) as wk_num, count(*) as n_days, max(wk_sales_qty) as qty,
       max(wk_sales_amt) as amt
from mart m join region on m.store_key = r_regionkey
     join (select distinct cast(substr(p_brand, 7) as integer) as prod_key, p_brand as brand_name
           from part) p on m.prod_key = p.prod_key
     join calendar c on m.yr_num = c.yr_num and m.wk_num = c.wk_num
group by 1, 2, 3, 4""",
    "s01_store_contract": "select " + ", ".join(
        [f"substr(c_name || ', {n}', 1, {limit}) as {n}" for n, limit in varchar_limits("store").items()]
    ) + """, cast(c_custkey as bigint) as store_key, c_custkey % 2 = 0 as frnchs_flg,
       cast(cast(c_custkey / 8 as decimal(19,3)) as double) as store_size,
       cast(c_custkey % 100 as bigint) as market_key, cast(c_custkey % 1000 as bigint) as submarket_key,
       cast(cast(c_custkey / 16 - 90 as decimal(19,6)) as double) as latitude,
       cast(cast(c_custkey / 32 as decimal(19,6)) as double) as longitude
from customer""",
    "r01_audit_of_snapshot": f"""
select {AS_OF} as run_date, 'calendar,inventory,product,sales,store' as present, '' as missing,
       cast(5 as bigint) as n_present, cast(0 as bigint) as n_missing, cast(0 as bigint) as n_unexpected,
       true as ready
union all
select cast({AS_OF} + 1 as date), 'calendar,inventory,product,sales', 'store', 4, 1, 0, false""",
    "r02_compact_replay": f"""with {SALES},{STOCK},{CALENDAR},{DAILY},
closes as (select yr_num as y, wk_num as w, max(cal_dt) as close from calendar group by 1, 2),
dated as (
  select d.*, c.*, close, cast(null as date) as as_of, close as valid_from
  from daily d join calendar c on trans_dt = cal_dt join closes on yr_num = y and wk_num = w
  where close <= (select max(as_of) from {REPLAY})
  union all
  select d.*, c.*, close, as_of, as_of as valid_from
  from daily d join calendar c on trans_dt = cal_dt join closes on yr_num = y and wk_num = w
       join {REPLAY.replace(' d(as_of)', ' e(as_of)')} on trans_dt <= as_of and as_of < close
),{_metrics('dated', 'as_of, valid_from, ' + WEEK_KEYS)}
select as_of, valid_from, {KEYS}, {MART_COLUMNS} from mart""",
    "k07_append_and_rerun": _mart(),
    "k05_byte_capped_parts": f"""{_LINES}
select count(*) as n_rows, cast(sum(sales_amt) as double) as amt, cast(sum(trans_id) as bigint) as ids, max(trans_dt) as last_dt,
       true as bounded, true as filled from sales""",
    "j01_from_buckets": f"{_DAILY}\nselect {DAY_ROW} from daily",
    "r02_dates_from_table": f"""{_REPLAY.replace(
        REPLAY, "(select distinct cast(o_orderdate as date) as as_of from orders where o_orderstatus = 'P') d"
    )}
select as_of, count(*) as n_rows, sum(wk_sales_qty) as qty, cast(sum(cast(wk_sales_amt as decimal(18,2))) as double) as amt,
       sum(eop_stock_on_hand_qty) as on_hand, cast(sum(out_of_stock_times) as bigint) as out_of_stock_times,
       cast(sum(low_stock_impact) as bigint) as low_stock_impact
from mart group by as_of""",
    "r02_compact_dates": f"""with {SALES},{STOCK},{CALENDAR},{DAILY},
closes as (select yr_num as y, wk_num as w, max(cal_dt) as close from calendar group by 1, 2),
dates as (select distinct cast(o_orderdate as date) as as_of from orders),
dated as (
  select d.*, c.*, close, cast(null as date) as as_of, close as valid_from
  from daily d join calendar c on trans_dt = cal_dt join closes on yr_num = y and wk_num = w
  where close <= (select max(as_of) from dates)
  union all
  select d.*, c.*, close, as_of, as_of as valid_from
  from daily d join calendar c on trans_dt = cal_dt join closes on yr_num = y and wk_num = w
       join dates on trans_dt <= as_of and as_of < close
),{_metrics('dated', 'as_of, valid_from, ' + WEEK_KEYS)}
select as_of, valid_from, {KEYS}, {MART_COLUMNS} from mart""",
    "r02_incremental_refresh": f"""{_MART.replace(
        "from daily join calendar on trans_dt = cal_dt)",
        "from daily join calendar on trans_dt = cal_dt "
        "where dayofyear(trans_dt) % 50 <> 2 and dayofyear(trans_dt) % 50 not between 30 and 44)",
    )}
select {KEYS}, {MART_COLUMNS} from mart""",
    "r02_changed_days": f"""with {SALES},{STOCK},{CALENDAR},
days as (
  select distinct 'sales' as fact, trans_dt as day from sales
  union all select distinct 'inventory', cal_dt from inventory
),
phased as (select *, dayofyear(day) % 50 as phase from days)
select fact, day, case phase when 0 then 'new' when 1 then 'changed' else 'withdrawn' end as status,
       case when phase < 2 then cast(yr_num as bigint) end as yr_num, case when phase < 2 then cast(wk_num as bigint) end as wk_num
from phased join calendar on day = cal_dt where phase < 3 or phase between 30 and 44""",
}
