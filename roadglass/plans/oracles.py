"""The queries of `queries.py` as SQL for DuckDB."""

_COUNTS = """select l_orderkey as o_orderkey, count(*)::bigint as involved, (count(*) filter (l_linestatus = 'F'))::bigint as finished,
  (count(*) filter (l_linestatus = 'O'))::bigint as opened from lineitem where l_returnflag = 'R' group by l_orderkey"""
_EVENTS = f"""select o.o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as event_date, strftime(o_orderdate, '%Y') as year,
  strftime(o_orderdate, '%m') as month, strftime(o_orderdate, '%d') as day, involved, finished, opened
  from orders o join ({_COUNTS}) c on o.o_orderkey = c.o_orderkey where o_orderstatus = 'F'"""


def _score(unit: str, period: str) -> str:
    return f"round(('0x' || substr(sha256({unit} || '|' || {period}), 1, 16))::ubigint::double / 18446744073709551615::double, 4)"


_MAP = f"""select n_nationkey as ordinal, n_nationkey::varchar as spatial_unit_id, n_name as name, event_type as period_id,
  {_score("n_nationkey::varchar", "event_type")} as value, null::varchar as label, 'default' as provider, 'development' as model_version,
  'unconfigured' as dataset_version from nation cross join (select distinct event_type from events)"""
_STRIP = r"regexp_replace({0}, '^[\s\x0B\x1c-\x1f\x85\p{{Z}}]+|[\s\x0B\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
_NULLS = "('', 'na', 'n/a', 'null', 'none', 'nan')"
_INT = r"'^[+-]?\d+(_\d+)*$'"
_FLOAT = r"'(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$'"


def _cells(table: str, columns: dict[str, str], ordinal: str) -> str:
    """Every cell: pos, name, ordinal, value (null for null tokens)."""
    parts = [f"select {i} as pos, '{c}' as name, {ordinal} as o, {e} as v from {table}" for i, (c, e) in enumerate(columns.items())]
    return f"select pos, name, o, case when v is null or lower(trim(v)) in {_NULLS} then null else trim(v) end as v from ({' union all '.join(parts)})"


_CUSTOMER = _cells(
    "customer",
    {
        "c_custkey": "c_custkey::varchar",
        "c_name": "c_name",
        "c_nationkey": "c_nationkey::varchar",
        "c_acctbal": "c_acctbal::varchar",
        "c_mktsegment": "case when c_custkey % 3 = 0 then ' N/A ' else c_mktsegment end",
    },
    "c_custkey",
)
_EVENT_COLUMNS = {"event_id": "event_id::varchar", "ts": "ts::varchar", "user_id": "user_id::varchar", "event_type": "event_type", "value": "value::varchar", "props": "props"}
_EVENT = _cells("events", _EVENT_COLUMNS, "event_id")
_KINDS = f"""select *, case when v is null then null when lower(v) in ('true', 'false', 'yes', 'no', 'si', 'sí') then 'boolean'
  when regexp_matches(v, {_INT}) then 'integer' when regexp_matches(v, {_FLOAT}) then 'float'
  when try_cast(v as timestamp) is not null then 'datetime' else 'string' end as kind from ({_EVENT})"""
_TYPES = f"""select pos, name, count(v)::bigint as n, (count(*) filter (kind = 'boolean'))::bigint as boolean, (count(*) filter (kind = 'integer'))::bigint as integer,
  (count(*) filter (kind = 'float'))::bigint as float, (count(*) filter (kind = 'datetime'))::bigint as datetime,
  (count(*) filter (kind = 'string'))::bigint as string from ({_KINDS}) group by pos, name"""
_INFERRED = f"""select *, case when n = 0 then 'empty' when greatest(boolean, integer + float, datetime) / n < 0.9 then 'string'
  when boolean = greatest(boolean, integer + float, datetime) then 'boolean'
  when integer + float = greatest(boolean, integer + float, datetime) then case when float > 0 then 'float' else 'integer' end
  else 'datetime' end as inferred_type from ({_TYPES})"""
_CAPPED = _cells("events", _EVENT_COLUMNS | {"value": "case when event_id % 5 < 3 then null else value::varchar end"}, "event_id")

#: Orders and their lines as crash and people records, to the event table's 29 columns.
_PEDESTRIANS = """select 'LIMA-' || l_orderkey as crash_id, count(*)::bigint as pedestrians_involved, (count(*) filter (l_linestatus = 'F'))::bigint as pedestrian_fatalities,
  (count(*) filter (l_linestatus = 'O'))::bigint as pedestrian_injured from lineitem where l_returnflag = 'R' and l_linenumber <> 5 group by l_orderkey"""
_BUILT = f"""with c as (
  select *, 'LIMA-' || o_orderkey as crash_id, case when o_orderkey % 3 = 2 then 's/f' else strftime(o_orderdate, '%Y-%m-%d') end as crash_date
  from orders where o_orderkey % 10 <> 0 and o_custkey % 5 <> 0)
  select c.crash_id, crash_date, case when o_orderkey % 2 = 1 then '07:08:09' else '08:30' end as crash_time,
    case when crash_date = 's/f' then '' else strftime(o_orderdate, '%Y') end as year, case when crash_date = 's/f' then '' else strftime(o_orderdate, '%m') end as month,
    case when crash_date = 's/f' then '' else strftime(o_orderdate, '%d') end as day, replace(o_orderpriority, '-', ' - ') as district,
    case when o_orderkey % 7 <> 0 then o_totalprice / 4000 end as latitude, (-77.5)::double as longitude, '' as crash_class,
    (o_orderkey % 4)::bigint as fatalities_total, (o_orderkey % 3)::bigint as injured_total, null::bigint as vehicles_damaged,
    pedestrians_involved, pedestrian_fatalities, pedestrian_injured, '' as zone, '' as road_type, '' as road_network, '' as road_code, '' as weather_condition, '' as zoning,
    '' as road_characteristics, '' as road_longitudinal_profile, '' as road_surface, '' as vertical_sign_exists, '' as horizontal_sign_exists, '' as main_cause, '' as specific_cause
  from c join ({_PEDESTRIANS}) p on c.crash_id = p.crash_id"""
_CATALOG = """(values (0, 'cercado-de-lima', 'Cercado de Lima', -12.0464, -77.0428), (1, 'la-victoria', 'La Victoria', -12.0678, -77.0150),
  (2, 'san-isidro', 'San Isidro', -12.0977, -77.0365), (3, 'miraflores', 'Miraflores', -12.1219, -77.0299), (4, 'santiago-de-surco', 'Santiago de Surco', -12.1456, -76.9919),
  (5, 'san-miguel', 'San Miguel', -12.0776, -77.0884), (6, 'los-olivos', 'Los Olivos', -11.9912, -77.0708),
  (7, 'san-juan-de-lurigancho', 'San Juan de Lurigancho', -11.9828, -77.0030)) t(ordinal, spatial_unit_id, name, latitude, longitude)"""
#: The customers' file as its rows: texts, null for null tokens.
_FILE = """select k, i, k::varchar as id, c_name as name, strftime(date '1992-01-01' + (k % 2000)::int, '%d/%m/%Y') as since, lat::varchar as lat, lon::varchar as lon,
  case when k % 3 = 0 then ' N/A ' else c_mktsegment || ';' end as segment, lat as lat_value, lon as lon_value, date '1992-01-01' + (k % 2000)::int as day
  from (select c_custkey as k, c_acctbal / 50 as lat, c_nationkey * 20 - 180 as lon, * from customer) join (values (0), (1)) t(i) on i = 0 or k % 50 = 0"""

SQL = {
    "event_table": _EVENTS,
    "event_summary": f"""select count(*)::bigint as rows, (count(*) filter (o_totalprice between 1000 and 200000))::bigint as valid_rows,
      coalesce(sum(finished), 0)::bigint as finished, coalesce(sum(opened), 0)::bigint as opened from ({_EVENTS})""",
    "events_by_year": f"select year, count(*)::bigint as events from ({_EVENTS}) where year <> '' group by year",
    "conditional_counts": _COUNTS,
    "semi_join_orders": "select o_orderkey, o_custkey, o_orderstatus from orders o where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')",
    "risk_map": _MAP,
    "risk_point": f"""select n_name as spatial_unit_id, 'period-a' as period_id, {_score("n_name", "'period-a'")} as value, null::varchar as label,
      'default' as provider, 'development' as model_version, 'unconfigured' as dataset_version from nation where n_nationkey = 7""",
    "risk_scores": f"select o_orderkey, {_score('o_custkey::varchar', 'o_orderstatus')} as value from orders",
    "risk_compare": f"""select u as spatial_unit_id, p as period_id, {_score("u", "p")} as value, null::varchar as label, 'default' as provider,
      'development' as model_version, 'unconfigured' as dataset_version
      from (values ('area-a', 'period-a'), ('area-b', 'period-a'), ('area-a', 'period-a'), ('miraflores', 'period-c')) t(u, p)""",
    "risk_bucket": f"""select spatial_unit_id, period_id, case when value is null then 'none' when value < 0.33 then 'low' when value < 0.66 then 'mid' else 'high' end as bucket,
      case when value is null then '#64748b' when value < 0.33 then '#0f766e' when value < 0.66 then '#d97706' else '#b91c1c' end as color,
      coalesce(9.0::double + value * 11, 10.0) + case when spatial_unit_id = '3' then 3.0 else 0.0 end as radius, coalesce(printf('%.4f', value), 'No value') as shown from ({_MAP})""",
    "risk_overview": f"select period_id, count(*)::bigint as areas, round(avg(value), 6) as average_value from ({_MAP}) group by period_id",
    "unit_catalog": "select n_nationkey as ordinal, n_nationkey::varchar as spatial_unit_id, n_name as name from nation order by n_nationkey limit 2",
    "selection_carry_over": f"""select period_id, spatial_unit_id, value from (select *, row_number() over (partition by period_id order by
      (spatial_unit_id = '5') desc, ordinal) as r from ({_MAP}) where value > 0.4) where r = 1""",
    "period_exists": """select p as period_id, p in (select event_type from events) as known
      from (values ('click'), ('purchase'), ('no-such-period')) t(p)""",
    "name_lookup": """select c_custkey, coalesce(n_name, c_nationkey::varchar) as name from customer
      left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey""",
    "registry_primary": "select n_nationkey as pos, n_name as id, 'primary' as role from nation where n_regionkey = 1",
    "registry_select": """select * from (values (1, 'people_fatal_crashes_2021_2025', 'primary', 'people_fatal_crashes_2021_2025.xlsx'),
      (3, 'historical_crashes_2008_2025', 'context', 'historical_crashes_2008_2025.xlsx')) t(pos, id, role, filename)""",
    "inventory_status": """select d.doc_id, source, case when quality is null then 'missing' else 'available' end as status, coalesce(quality::varchar, '') as quality
      from documents d left join labels l on d.doc_id = l.doc_id""",
    "header_top1": """select conv_id, turn, role, n as score from (select *, length(text)::int as n, row_number() over (partition by conv_id order by length(text) desc, turn) as r
      from conversations) where r = 1""",
    "header_rows": f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
      shown as (select doc_id, i, list_transform(string_split(line, ','), lambda x: {_STRIP.format("x")}) as c from lines where i <= 25),
      ends as (select doc_id, i, c, coalesce(list_max(list_transform(c, lambda x, k: case when x <> '' then k else 0 end)), 0) as last,
        len(list_filter(c, lambda x: x <> '')) as score from shown),
      best as (select *, row_number() over (partition by doc_id order by score desc, i) as r from ends)
      select doc_id::varchar as name, (40 - i)::int as rows, i::int as header_row, last::int as n_columns, array_to_string(c[1:last], '|') as columns from best where r = 1""",
    "prefix_rows": "select conv_id, turn, role from conversations where turn < 3",
    "last_wins": """select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r
      from events) where r = 1""",
    "key_fold": "select doc_id, sha256(trim(regexp_replace(upper(strip_accents(text)), '[^A-Z0-9]+', ' ', 'g'))) as key_sha256 from documents",
    "key_fold_native": "select doc_id, sha256(trim(regexp_replace(upper(strip_accents(text)), '[^A-Z0-9]+', ' ', 'g'))) as key_sha256 from documents",
    "text_collapse": rf"""select doc_id, sha256(trim(regexp_replace(text, '[\s\x0B\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))) as collapsed_sha256,
      length({_STRIP.format("text")})::int as stripped_length from documents""",
    "null_tokens": f"""select token, count(*)::bigint as n, bool_and(lower(trim(token)) in {_NULLS}) as is_null from (
      select ['NA', ' n/a ', 'Null', 'none', 'NaN', '', '  ', '0', 'nano', 'nulls'][o_orderkey % 10 + 1] as token from orders) group by token""",
    "boolean_tokens": """select token, count(*)::bigint as n, bool_and(lower(token) in ('true', 'false', 'yes', 'no', 'si', 'sí')) as is_boolean from (
      select ['TRUE', 'false', 'Yes', 'NO', 'si', 'SÍ', '1', 't', 'y', 'verdad'][o_orderkey % 10 + 1] as token from orders) group by token""",
    "number_parse": r"""select c_custkey, case c_custkey % 4 when 0 then n when 1 then -(n + 0.75) when 2 then n / 100 end as number,
      coalesce((case c_custkey % 4 when 0 then n when 1 then -n when 2 then trunc(n / 100) end::bigint)::varchar, '') as whole
      from (select c_custkey, regexp_extract(c_name, '(\d+)', 1)::double as n from customer)""",
    "date_parse": """select o_orderkey, case when o_orderkey % 5 = 4 then 'n.d.' else strftime(o_orderdate, '%Y-%m-%d') end as iso_date,
      case when o_orderkey % 5 = 4 then null else strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' end as parsed from orders""",
    "date_parts": "select o_orderkey, strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%m') as month, strftime(o_orderdate, '%d') as day from orders",
    "profile_counts": f"""select name, count(v)::bigint as non_null_count, (count(*) - count(v))::bigint as null_count,
      round_even((count(*) - count(v)) / count(*) * 100, 2) as null_pct, least(count(distinct v), 100000)::bigint as unique_count,
      count(distinct v) > 100000 as unique_count_is_capped from ({_CUSTOMER}) group by pos, name""",
    "profile_types": f"""select name, inferred_type, case when n > 0 and inferred_type <> 'string' then round_even(greatest(boolean, integer + float, datetime) / n * 100, 2) end
      as parse_success_pct, boolean, integer, float, datetime, string from ({_INFERRED})""",
    "profile_minmax": f"""select name, min(case when kind in ('integer', 'float') then v::double end) as num_min, max(case when kind in ('integer', 'float') then v::double end) as num_max,
      strftime(min(case when kind = 'datetime' then try_cast(v as timestamp) end), '%Y-%m-%d %H:%M:%S') as ts_min,
      strftime(max(case when kind = 'datetime' then try_cast(v as timestamp) end), '%Y-%m-%d %H:%M:%S') as ts_max from ({_KINDS}) group by pos, name""",
    "profile_samples": f"""select name, array_to_string((list(v order by f))[1:5], '|') as sample_values from (
      select pos, name, v, min(o) as f from ({_CUSTOMER}) where v is not null group by pos, name, v) group by pos, name""",
    "duplicate_rows": """select count(*)::bigint as row_count, (count(*) - count(distinct trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13))))::bigint as duplicate_row_count,
      round_even((count(*) - count(distinct trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)))) / count(*) * 100, 2) as duplicate_row_pct from documents""",
    "coordinate_quality": """select count(*)::bigint as paired_non_null_count, (count(*) filter (v))::bigint as valid_coordinate_count,
      round_even(count(*) filter (v) / count(*) * 100, 2) as valid_coordinate_pct from (
      select c_custkey % 11 <> 0 and c_acctbal / 100 between -90 and 90 and c_nationkey * 20 - 180 between -180 and 180 as v from customer where c_custkey % 7 <> 0)""",
    "temporal_candidates": f"select pos, name from ({_INFERRED}) where inferred_type = 'datetime'",
    "profile_warnings": f"""with c as (select pos, name, count(*) as n, count(v) as k, count(distinct v) as u from ({_CAPPED}) group by pos, name),
      w as (select pos, 0 as a, 'Column ''' || name || ''' is at least 50% null.' as message from c where round_even((n - k) / n * 100, 2) >= 50
        union all select pos, 1 as a, 'Column ''' || name || ''' unique count reached the tracking cap (500).' from c where u > 500)
      select pos, (row_number() over (partition by pos order by a) - 1)::int as k, message from w""",
    "content_digest": "select doc_id, sha256(text) as sha256, strlen(text)::int as size_bytes from documents",
    "json_extract": "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events",
    "event_build": _BUILT,
    "event_build_summary": f"""select count(*)::bigint as rows, (count(*) filter (latitude between -90 and 90))::bigint as valid_coordinate_rows,
      coalesce(sum(pedestrian_fatalities), 0)::bigint as pedestrian_fatalities, coalesce(sum(pedestrian_injured), 0)::bigint as pedestrian_injured from ({_BUILT})""",
    "event_build_by_year": f"select year, count(*)::bigint as events from ({_BUILT}) where year <> '' group by year",
    "pedestrian_counts": _PEDESTRIANS,
    "iso_times": "select event_id, case when event_id % 3 = 2 then strftime(ts, '%H:%M') else strftime(ts, '%H:%M:%S') end as time from events",
    "date_offsets": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as moment from events",
    "registry_json": """select (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as pos, n_name as id, n_name || '"é.xlsx' as filename from nation""",
    "registry_all": """select * from (values (0, 'fatal_crashes_2021_2025', 'primary', '2026-02-27', 'fatal_crashes_2021_2025.xlsx', 114),
      (1, 'people_fatal_crashes_2021_2025', 'primary', '2026-02-27', 'people_fatal_crashes_2021_2025.xlsx', 102),
      (2, 'vehicles_fatal_crashes_2021_2025', 'supporting', '2026-02-27', 'vehicles_fatal_crashes_2021_2025.xlsx', 103),
      (3, 'historical_crashes_2008_2025', 'context', '2025-12-18', 'historical_crashes_2008_2025.xlsx', 117)) t(pos, id, role, published, filename, url_length)""",
    "risk_service": f"""select spatial_unit_id, 'period-b' as period_id, {_score("spatial_unit_id", "'period-b'")} as value, null::varchar as label, 'default' as provider,
      'development' as model_version, 'unconfigured' as dataset_version, name, latitude::double as latitude, longitude::double as longitude from {_CATALOG}""",
    "risk_service_body": f"""select 'health' as operation, '{{"status": "ok", "environment": "development"}}' as body union all
      select 'metadata', '{{"provider": "default", "model_version": "development", "dataset_version": "unconfigured", "description": "Risk scoring provider used by the application."}}' union all
      select 'risk', '{{"spatial_unit_id": "area-a", "period_id": "period-a", "value": ' || {_score("'area-a'", "'period-a'")} ||
        ', "label": null, "provider": "default", "model_version": "development", "dataset_version": "unconfigured"}}' union all
      select 'periods', '[{{"period_id": "period-a", "name": "Period A"}}, {{"period_id": "period-b", "name": "Period B"}}, {{"period_id": "period-c", "name": "Period C"}}]'""",
    "risk_provider": """select n_name as spatial_unit_id, event_type as period_id, case when event_type <> 'error' then round(length(n_name) / 100, 2) end as value,
      'by-length' as provider, '1' as model_version, 'none' as dataset_version from nation cross join (select distinct event_type from events)""",
    "coordinate_names": """select * from (values (1, null, null, 'id'), (2, 1, null, 'latitud'), (3, 1, 2, 'lon'), (4, 1, 2, 'lat'), (5, 1, 2, 'longitud'), (6, 1, 2, 'strasse'),
      (7, 1, 2, 'no ca')) t(columns, latitude, longitude, last_name)""",
    "shown_numbers": """select c_custkey, case when x = floor(x) then x::bigint::varchar else format('{:.12g}', x) end as shown
      from (select c_custkey, case when c_custkey % 2 = 0 then floor(c_acctbal) else c_acctbal end as x from customer)""",
    "workbook_records": """select (row_number() over (order by c_custkey) + 5)::int as row_number, case when c_custkey % 9 <> 0 then c_custkey::varchar end as id,
      case c_custkey % 5 when 0 then null when 1 then ' a <b> & "' || c_name else c_name end as name, strftime(date '1992-01-01' + (c_custkey % 2000)::int, '%Y-%m-%d') as day,
      round(c_acctbal * 100)::bigint::varchar as balance, (c_nationkey / 4)::double::varchar as quarter from customer qualify c_custkey % 9 <> 0""",
    "workbook_sheets": "select 'CLIENTES' as name, 5 as header_row, 'Código Siniestro|Nombre|FECHA|Balance (¢)|Cuarto' as columns from (select count(*) as n from customer)",
    "workbook_events": """with p as (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as dead, count(*) filter (o_orderstatus <> 'F') as hurt from orders where o_orderkey % 2 = 1 group by o_custkey),
      c as (select *, date '1992-01-01' + (c_custkey % 2000)::int as day from customer where c_custkey % 3 <> 2)
      select c_custkey::varchar as crash_id, strftime(day, '%Y-%m-%d') as crash_date, '08:30' as crash_time, strftime(day, '%Y') as year, c_mktsegment as zone,
        n as pedestrians_involved, dead as pedestrian_fatalities, hurt as pedestrian_injured from c join p on o_custkey = c_custkey""",
    "registry_file": """select (row_number() over (order by s_suppkey) - 1)::int as pos, s_name as id, 'primary' as role, s_name || '"é.xlsx' as filename from supplier qualify s_suppkey % 10 <> 0""",
    "registry_by_key": """select pos, id, role from (select (row_number() over (order by s_suppkey) - 1)::int as pos, s_name as id,
      case when s_suppkey % 10 = 0 then 'context' else 'primary' end as role from supplier) where id in (select min(s_name) from supplier group by s_nationkey)""",
    "service_map": f"""select c_custkey::varchar as spatial_unit_id, 'purchase' as period_id, {_score("c_custkey::varchar", "'purchase'")} as value, null::varchar as label, 'default' as provider,
      'development' as model_version, 'unconfigured' as dataset_version, c_name as name, (c_custkey % 90)::double as latitude, (-c_custkey % 180)::double as longitude from customer""",
    "service_answers": f"""with r as (select event_id as ordinal, case event_id % 50 when 0 then '' when 1 then null else 'u "' || user_id end as u, event_type as p from events)
      select ordinal, case when u <> '' then 200 else 422 end as status, case when u <> '' then u end as spatial_unit_id, case when u <> '' then p end as period_id,
        case when u <> '' then 'default' end as provider, null::varchar as label, case when u <> '' then {_score("u", "p")} end as value from r""",
    "trained_scores": """with recursive bits as (
        select range as i, range::bigint as c, 0 as k from range(256)
        union all select i, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), k + 1 from bits where k < 8),
      tab as (select list(c order by i) as t from bits where k = 8),
      h as (select event_id, user_id::varchar as u, event_type as p, value, list_transform(regexp_extract_all(hex(encode(event_id::varchar)), '..'), lambda x: ('0x' || x)::bigint) as y from events),
      e as (select u, p, value, xor(list_reduce(y, lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1]), 4294967295::bigint), 4294967295) % 5 as fold from h, tab),
      r as (select u, p, least(value / 200, 1.0)::double as y from e where fold <> 0 and u is not null and p is not null and value is not null),
      us as (select u, avg(y) as a from r group by u), ps as (select p, avg(y) as b from r group by p),
      m as (select avg(r.y) as y, avg(a) as a, avg(b) as b, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(r.y, a) as ya, covar_pop(r.y, b) as yb
        from r join us using (u) join ps using (p)),
      w as (select y, a, b, (ya * bb - yb * ab) / (aa * bb - ab * ab) as wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) as wb from m),
      q as (select distinct u, p from e where fold = 0),
      s as (select q.u, q.p, round(least(greatest(w.y + wa * (coalesce(us.a, w.y) - w.a) + wb * (coalesce(ps.b, w.y) - w.b), 0), 1), 4) as value from q cross join w left join us on us.u = q.u left join ps on ps.p = q.p)
      select u as spatial_unit_id, p as period_id, value, case when value < 0.33 then 'low' when value < 0.66 then 'mid' else 'high' end as label, 'trained' as provider, 'v1' as model_version, 'events' as dataset_version from s""",
    "csv_sink": """select 'n_nationkey,name,v' as line union all select n_nationkey || ',' || case when n_nationkey % 2 = 0 then concat('"', n_name, ', ', repeat('"', 2), 'x', repeat('"', 3)) else n_name end || ',' ||
      case n_nationkey % 3 when 0 then '' when 1 then (n_nationkey / 8)::varchar else '1e-07' end from nation""",
    "ordered_sink": """select row_number() over (order by c_acctbal desc, c_custkey) - 1 as place, c_custkey, c_acctbal::double as balance,
      c_mktsegment || case when c_custkey % 7 = 0 then chr(10) || '"again"' else '' end as segment from customer""",
    "csv_scan": f"""select ';' as delimiter, id, name, since, lat, lon, segment from ({_FILE})""",
    "csv_malformed": f"""select count(*)::bigint as row_count, (count(*) filter (k % 100 = 7))::bigint as malformed_count from ({_FILE})""",
    "profile_report": f"""with f as ({_FILE}), a as (select count(*) as n, count(*) filter (k % 3 <> 0) as m, count(distinct lat) as lats, count(distinct lon) as lons, count(distinct since) as days,
        count(distinct case when k % 3 <> 0 then segment end) as segments, count(distinct k) as ks, min(k) as k0, max(k) as k1, min(lat_value) as a0, max(lat_value) as a1,
        min(lon_value) as o0, max(lon_value) as o1, min(day) as d0, max(day) as d1 from f),
      v as (select 'id' as name, id as v, k, i from f union all select 'name', name, k, i from f union all select 'since', since, k, i from f union all select ' LATITÚD ', lat, k, i from f
        union all select 'Lon', lon, k, i from f union all select 'segment', segment, k, i from f where k % 3 <> 0),
      s as (select name, array_to_string((list(v order by k))[1:5], '|') as sample_values from (select name, v, min(k) as k from v group by name, v) group by name),
      r as (select 'id' as name, 'integer' as t, n, 0 as z, ks as u, 100.0::double as p, k0::varchar as lo, k1::varchar as hi from a union all
        select 'name', 'string', n, 0, ks, null, null, null from a union all
        select 'since', 'datetime', n, 0, days, 100.0, strftime(d0, '%Y-%m-%dT00:00:00'), strftime(d1, '%Y-%m-%dT00:00:00') from a union all
        select ' LATITÚD ', 'float', n, 0, lats, 100.0, format('{{:.12g}}', a0), format('{{:.12g}}', a1) from a union all
        select 'Lon', 'integer', n, 0, lons, 100.0, o0::varchar, o1::varchar from a union all
        select 'segment', 'string', m, n - m, segments, null, null, null from a)
      select name, t as inferred_type, n::bigint as non_null_count, z::bigint as null_count, round_even(z / (n + z) * 100, 2) as null_pct, u::bigint as unique_count, p as parse_success_pct,
        lo as minimum, hi as maximum, sample_values from r join s using (name)""",
    "profile_totals": f"""with f as ({_FILE}), t as (select count(*) as n, count(*) - count(distinct k) as d, count(*) filter (k % 100 = 7) as bad,
        count(*) filter (lat_value between -90 and 90 and lon_value between -180 and 180) as ok from f)
      select ';' as delimiter, n::bigint as row_count, 6::bigint as column_count, d::bigint as duplicate_row_count, round_even(d / n * 100, 2) as duplicate_row_pct, ' LATITÚD ' as latitude_column,
        'Lon' as longitude_column, n::bigint as paired, ok::bigint as valid, round_even(ok / n * 100, 2) as valid_pct, 'since' as temporal,
        'Detected ' || d || ' exact duplicate row(s).|Detected ' || bad || ' malformed row(s) with extra fields.' ||
          case when round_even(ok / n * 100, 2) < 90 then '|Less than 90% of non-null coordinate pairs are geographically valid.' else '' end as warnings from t""",
}
