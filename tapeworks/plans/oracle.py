"""DuckDB SQL that gives the rows of plans.queries, over the same tables."""

from __future__ import annotations

from ..functions.kernels import PROFILES
from .queries import BLOCK, PIPELINE_RUNS

TRADES = """trades AS MATERIALIZED (
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS session_id,
    row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY l_shipdate,l_quantity,l_linestatus,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_discount,l_tax,l_returnflag) - 1 AS seq,
    CAST(l_quantity AS BIGINT) * 100000000 AS price_e8, CAST(round(l_extendedprice * 100) AS BIGINT) * 1000000 AS qty_e8,
    CAST(l_linestatus = 'O' AS BIGINT) AS side, epoch_us(l_shipdate) * 1000 AS ts_ns
  FROM lineitem)"""
BOOK = """book AS MATERIALIZED (
  SELECT strftime(ts, '%Y-%m-%d') AS session_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS seq,
    CAST(round(value * 100) AS BIGINT) * 1000000 AS bid_price_e8, CAST((user_id % 20 + 1) * 100000000 AS BIGINT) AS bid_qty_e8,
    CAST(CAST(round(value * 100) AS BIGINT) * 1000000 + (event_id % 3 + 1) * 1000000 AS BIGINT) AS ask_price_e8, CAST((event_id % 10 + 1) * 100000000 AS BIGINT) AS ask_qty_e8, epoch_us(ts) * 1000 AS ts_ns
  FROM events)"""
LEVELS = """levels AS MATERIALIZED (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS session_id,
    dense_rank() OVER (PARTITION BY year(o_orderdate) ORDER BY epoch_us(o_orderdate) * 1000 + o_orderkey, o_orderkey) - 1 AS batch,
    row_number() OVER (PARTITION BY year(o_orderdate), epoch_us(o_orderdate) * 1000 + o_orderkey, o_orderkey ORDER BY l_linenumber,l_partkey,l_extendedprice,l_suppkey,l_quantity,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) - 1 AS pos,
    epoch_us(o_orderdate) * 1000 + o_orderkey AS ts_ns, CAST(l_quantity AS BIGINT) * 100000000 AS price_e8,
    CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE (l_suppkey + 1) * 1000000 END AS BIGINT) AS qty_e8, CAST(l_linestatus = 'O' AS BIGINT) AS side
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def _gcd(c: str) -> str:
    return f"CAST(list_reduce(list(DISTINCT {c}), lambda a, b: gcd(a, b)) AS BIGINT)"


def _vl(c: str) -> str:
    return f"CAST((length(bin(CAST({c} AS BIGINT))) + 6) // 7 AS BIGINT)"


def _zz(c: str) -> str:
    return f"(CASE WHEN {c} >= 0 THEN 2 * {c} ELSE -2 * {c} - 1 END)"


def _sum(c: str) -> str:
    return f"CAST(sum({c}) AS BIGINT)"


def _q(select: str, *ctes: str) -> str:
    return (f"WITH {', '.join(ctes)} " if ctes else "") + select


CH = "ch AS (SELECT *, seq // 16384 AS chunk FROM trades)"
SC = f"""sc AS MATERIALIZED (SELECT session_id, chunk, count(*) AS records, arg_min(ts_ns, seq) AS base_ts, arg_min(price_e8, seq) AS base_price,
  {_gcd('price_e8')} AS price_scale, {_gcd('qty_e8')} AS qty_scale, {_gcd('ts_ns')} AS time_scale FROM ch GROUP BY ALL)"""
RUNS = """fl AS MATERIALIZED (SELECT *, CAST(coalesce(lag(ts_ns) OVER w <> ts_ns, true) AS BIGINT) AS new_t,
    CAST(coalesce(lag(ts_ns) OVER w <> ts_ns OR lag(price_e8) OVER w <> price_e8 OR lag(side) OVER w <> side, true) AS BIGINT) AS new_p FROM ch WINDOW w AS (PARTITION BY session_id, chunk ORDER BY seq)),
  rn AS MATERIALIZED (SELECT *, CAST(sum(new_t) OVER w - 1 AS BIGINT) AS tg, CAST(sum(new_p) OVER w - 1 AS BIGINT) AS pg FROM fl WINDOW w AS (PARTITION BY session_id, chunk ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
PG = f"""g1 AS (SELECT session_id, chunk, pg, min(tg) AS tg, count(*) AS n, min(side) AS side, min(price_e8) // min(price_scale) AS price_tick, min(base_price) // min(price_scale) AS bt FROM rn JOIN sc USING (session_id, chunk) GROUP BY session_id, chunk, pg),
  g2 AS MATERIALIZED (SELECT *, price_tick - coalesce(lag(price_tick) OVER (PARTITION BY session_id, chunk ORDER BY pg), bt) AS dp FROM g1),
  pgs AS (SELECT session_id, chunk, pg, tg, n, side, price_tick, dp, {_zz('dp')} AS dp_zigzag, CAST(dp = 0 AS BIGINT) AS dp_zero, CAST(n = 1 AS BIGINT) AS count_one FROM g2)"""
TG = """t1 AS (SELECT session_id, chunk, tg, count(*) AS n, CAST(sum(new_p) AS BIGINT) AS price_groups, min(ts_ns) // min(time_scale) AS ts_unit, min(base_ts) // min(time_scale) AS bt FROM rn JOIN sc USING (session_id, chunk) GROUP BY session_id, chunk, tg),
  tgs AS (SELECT session_id, chunk, tg, n, price_groups, ts_unit, ts_unit - coalesce(lag(ts_unit) OVER (PARTITION BY session_id, chunk ORDER BY tg), bt) AS dt, CAST(price_groups = 1 AS BIGINT) AS price_group_count_one FROM t1)"""
RK = "lots AS MATERIALIZED (SELECT session_id, chunk, seq, qty_e8 // qty_scale AS lot FROM ch JOIN sc USING (session_id, chunk)), hi AS (SELECT session_id, chunk, lot, count(*) AS n FROM lots GROUP BY ALL), rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, chunk ORDER BY n DESC, lot) - 1 AS rank FROM hi)"
COST = f"""c1 AS (SELECT session_id, chunk, CAST(capacity AS BIGINT) AS capacity, {_sum('n')} AS records, {_sum('CASE WHEN rank < capacity THEN 1 ELSE 0 END')} AS hot,
    {_sum('CASE WHEN rank < capacity THEN 0 ELSE n END')} AS escapes, {_sum('CASE WHEN rank < capacity THEN 0 ELSE n * ' + _vl('lot') + ' END')} AS escape_bytes
    FROM rk CROSS JOIN (VALUES (16), (32), (64), (128)) v(capacity) GROUP BY ALL),
  cost AS MATERIALIZED (SELECT *, length(bin(capacity)) AS bits, (records * length(bin(capacity)) + 7) // 8 + escape_bytes + 2 * hot + escapes AS cost FROM c1),
  cap AS MATERIALIZED (SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY session_id, chunk ORDER BY cost, capacity) = 1),
  dict AS MATERIALIZED (SELECT session_id, chunk, rank AS code, lot, n FROM rk JOIN (SELECT session_id, chunk, capacity FROM cap) USING (session_id, chunk) WHERE rank < capacity)"""
_TR = [TRADES, CH, SC]
_SZ = f"""sz AS (SELECT session_id, chunk, records, price_groups, dp_zero_count, count_one_count, price_bytes, time_groups, price_group_count_one_count, time_bytes, bits AS hot_bits, escapes AS qty_escapes, escape_bytes AS qty_escape_bytes, hot_table_bytes,
    (price_groups + 7) // 8 AS flag_bytes, (time_groups + 7) // 8 AS pgc1_bytes, (records * bits + 7) // 8 AS qty_code_bytes,
    hot_table_bytes + time_bytes + price_bytes + 3 * ((price_groups + 7) // 8) + (time_groups + 7) // 8 + (records * bits + 7) // 8 + escape_bytes AS payload_bytes
  FROM (SELECT session_id, chunk, records FROM sc)
  JOIN (SELECT session_id, chunk, count(*) AS price_groups, {_sum('dp_zero')} AS dp_zero_count, {_sum('count_one')} AS count_one_count, {_sum(f"CASE WHEN dp <> 0 THEN {_vl('dp_zigzag')} ELSE 0 END + CASE WHEN n <> 1 THEN {_vl('n - 2')} ELSE 0 END")} AS price_bytes FROM pgs GROUP BY ALL) USING (session_id, chunk)
  JOIN (SELECT session_id, chunk, count(*) AS time_groups, {_sum('price_group_count_one')} AS price_group_count_one_count, {_sum(f"{_vl('dt')} + CASE WHEN price_groups <> 1 THEN {_vl('price_groups')} ELSE 0 END")} AS time_bytes FROM tgs GROUP BY ALL) USING (session_id, chunk)
  JOIN (SELECT session_id, chunk, bits, escapes, escape_bytes FROM cap) USING (session_id, chunk)
  JOIN (SELECT session_id, chunk, {_sum(_vl('lot'))} AS hot_table_bytes FROM dict GROUP BY ALL) USING (session_id, chunk))"""
_LT = "lt AS (SELECT session_id, seq, '[' || price_e8 || ',' || qty_e8 || ',' || side || ',' || ts_ns || ']' AS line FROM trades)"
_LB = "lb AS (SELECT session_id, seq, '[' || bid_price_e8 || ',' || bid_qty_e8 || ',' || ask_price_e8 || ',' || ask_qty_e8 || ',' || ts_ns || ']' AS line FROM book)"

BS = f"""bsc AS (SELECT session_id, {_gcd('p')} AS price_scale, {_gcd('q')} AS qty_scale, {_gcd('ts_ns')} AS time_scale FROM (
    SELECT session_id, bid_price_e8 AS p, bid_qty_e8 AS q, ts_ns FROM book UNION ALL SELECT session_id, ask_price_e8, ask_qty_e8, ts_ns FROM book) GROUP BY session_id)"""
_D = lambda e, n: f"{e} - coalesce(lag({e}) OVER w, {e}) AS d_{n}"
BD = f"""bd AS (SELECT session_id, seq, seq // 16384 AS chunk, {_D('(ts_ns // time_scale)', 't')}, {_D('(bid_price_e8 // price_scale)', 'bid')}, {_D('((ask_price_e8 - bid_price_e8) // price_scale)', 'spread')},
    {_D('(bid_qty_e8 // qty_scale)', 'bid_qty')}, {_D('(ask_qty_e8 // qty_scale)', 'ask_qty')} FROM book JOIN bsc USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY seq))"""
_MASK = "CAST(CASE WHEN d_bid <> 0 THEN 1 ELSE 0 END + CASE WHEN d_spread <> 0 THEN 2 ELSE 0 END + CASE WHEN d_bid_qty <> 0 THEN 4 ELSE 0 END + CASE WHEN d_ask_qty <> 0 THEN 8 ELSE 0 END AS BIGINT)"
_BB = [BOOK, BS, BD]

DS = f"dsc AS (SELECT session_id, abs({_gcd('price_e8')}) AS price_scale, abs({_gcd('qty_e8')}) AS qty_scale, {_gcd('ts_ns')} AS time_scale FROM levels GROUP BY session_id)"
BEST = """up AS (SELECT session_id, side, price_e8, batch, arg_max(qty_e8, pos) AS qty FROM levels GROUP BY ALL),
  iv AS (SELECT *, lead(batch) OVER (PARTITION BY session_id, side, price_e8 ORDER BY batch) AS died FROM up),
  bt AS (SELECT DISTINCT session_id, batch FROM levels),
  best AS (SELECT bt.session_id, bt.batch, max(CASE WHEN side = 0 THEN price_e8 END) AS best_bid, min(CASE WHEN side = 1 THEN price_e8 END) AS best_ask
    FROM bt LEFT JOIN (SELECT * FROM iv WHERE qty > 0) l ON l.session_id = bt.session_id AND l.batch < bt.batch AND (l.died IS NULL OR bt.batch <= l.died) GROUP BY ALL)"""
OFF = """of1 AS (SELECT l.*, qty_scale, time_scale, price_e8 // price_scale AS price_tick, (CASE WHEN side = 0 THEN best_bid ELSE best_ask END) // price_scale AS best_tick FROM levels l JOIN best USING (session_id, batch) JOIN dsc USING (session_id)),
  ofs AS (SELECT *, CASE WHEN side = 0 THEN best_tick - price_tick ELSE price_tick - best_tick END AS "offset" FROM of1),
  md1 AS (SELECT *, CASE WHEN coalesce(lag(side) OVER (PARTITION BY session_id, batch ORDER BY pos) <= side, true) AND coalesce("offset" >= coalesce(lag("offset") OVER s, 0), false) THEN 1 ELSE 0 END AS fits,
    "offset" - coalesce(lag("offset") OVER s, 0) AS gap FROM ofs WINDOW s AS (PARTITION BY session_id, batch, side ORDER BY pos)),
  md AS (SELECT *, CAST(min(fits) OVER (PARTITION BY session_id, batch) AS BIGINT) AS run_mode FROM md1)"""
HOT = "dh AS (SELECT session_id, side, qty_e8, count(*) AS n, row_number() OVER (PARTITION BY session_id, side ORDER BY count(*) DESC, qty_e8) - 1 AS code FROM levels WHERE qty_e8 <> 0 GROUP BY session_id, side, qty_e8), hot AS (SELECT * FROM dh WHERE code < 64)"
RM = "rm AS (SELECT session_id, batch, count(*) AS level_count, min(run_mode) AS run_mode, CAST(sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bid_count, CAST(sum(side) AS BIGINT) AS ask_count FROM md GROUP BY session_id, batch)"
_DD = [LEVELS, DS, BEST, OFF]
_LVL = "SELECT session_id, batch, pos, ts_ns, price_e8, qty_e8, side FROM levels"

_DEPTH_STATS = f"""SELECT *, 176 + hot_table_bytes + batch_bytes + side_bytes + delete_bytes + price_bytes + qty_code_bytes + qty_escape_bytes AS encoded_bytes,
  CAST(176 + hot_table_bytes + batch_bytes + side_bytes + delete_bytes + price_bytes + qty_code_bytes + qty_escape_bytes AS DOUBLE) / level_count AS bytes_per_level FROM (
  SELECT a.* EXCLUDE (explicit_levels), batch_count, run_mode_batches, fallback_batches, batch_bytes, coalesce(hot_table_bytes, 0) AS hot_table_bytes, (explicit_levels + 7) // 8 AS side_bytes, (level_count + 7) // 8 AS delete_bytes, 8 * batch_count + 32 * level_count AS raw_runtime_bytes FROM (
   SELECT session_id, count(*) AS level_count, {_sum('CASE WHEN qty_e8 = 0 THEN 1 ELSE 0 END')} AS delete_count, {_sum('CASE WHEN qty_e8 <> 0 AND code IS NULL THEN 1 ELSE 0 END')} AS qty_escape_count,
    {_sum('CASE WHEN "offset" IS NOT NULL THEN 1 ELSE 0 END')} AS offset_price_count, {_sum('CASE WHEN "offset" IS NULL THEN 1 ELSE 0 END')} AS absolute_price_count, {_sum('CASE WHEN run_mode <> 1 THEN 1 ELSE 0 END')} AS explicit_levels,
    {_sum(f'CASE WHEN run_mode = 1 THEN {_vl("gap")} WHEN "offset" IS NOT NULL THEN ' + _vl(_zz('"offset"')) + f' ELSE {_vl(_zz("price_tick"))} END')} AS price_bytes,
    {_sum(f"CASE WHEN qty_e8 <> 0 THEN {_vl('coalesce(code, table_size, 0)')} ELSE 0 END")} AS qty_code_bytes, {_sum(f"CASE WHEN qty_e8 <> 0 AND code IS NULL THEN {_vl('qty_e8 // qty_scale')} ELSE 0 END")} AS qty_escape_bytes
   FROM md LEFT JOIN (SELECT session_id, side, qty_e8, code FROM hot) USING (session_id, side, qty_e8) LEFT JOIN (SELECT session_id, side, count(*) AS table_size FROM hot GROUP BY ALL) USING (session_id, side) GROUP BY session_id) a
  JOIN (SELECT session_id, count(*) AS batch_count, {_sum('run_mode')} AS run_mode_batches, {_sum('1 - run_mode')} AS fallback_batches,
    {_sum(f"{_vl('dt')} + {_vl('level_count')} + 1 + CASE WHEN run_mode = 1 THEN {_vl('bid_count')} + {_vl('ask_count')} ELSE 0 END")} AS batch_bytes
    FROM rm JOIN (SELECT session_id, batch, t - coalesce(lag(t) OVER (PARTITION BY session_id ORDER BY batch), t) AS dt FROM (SELECT session_id, batch, min(ts_ns // time_scale) AS t FROM levels JOIN dsc USING (session_id) GROUP BY ALL)) USING (session_id, batch) GROUP BY session_id) b USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) * 8 AS hot_table_bytes FROM hot GROUP BY ALL) h USING (session_id))"""

_MUT = "CASE WHEN seq % 1000 = 7 THEN regexp_replace(line, '000\\]$', '001]') WHEN seq % 1000 = 11 THEN replace(line, ',', ', ') ELSE line END"


def _pairs(canonical: str, decoded: str, fields: list[str]) -> str:
    """Line by line compare; fields are read from the text by position, time first."""
    def part(p: str, i: int) -> str:
        return f"CAST(trim(string_split(trim({p}, '[]'), ',')[{i}]) AS BIGINT)"

    n = len(fields) + 1
    case = f"CASE WHEN c IS NULL THEN 'extra_decoded_record' WHEN d IS NULL THEN 'missing_decoded_record' WHEN {part('c', n)} <> {part('d', n)} THEN 'ts_ns' " + " ".join(f"WHEN {part('c', i + 1)} <> {part('d', i + 1)} THEN '{f}'" for i, f in enumerate(fields)) + " END"
    return f"""pair AS (SELECT session_id, seq + 1 AS line_no, x.line AS c, y.line AS d FROM ({canonical}) x FULL JOIN ({decoded}) y USING (session_id, seq)), cmp AS MATERIALIZED (SELECT *, {case} AS field FROM pair)"""


def _depth_pairs(canonical: str, decoded: str) -> str:
    """The same for depth: time, number of levels, levels."""
    last, head = (lambda p: f"CAST(trim(regexp_extract({p}, '([0-9-]+)\\]$', 1)) AS BIGINT)"), (lambda p: f"regexp_replace(replace({p}, ' ', ''), ',[0-9-]+\\]$', '')")
    levels = lambda p: f"len(string_split({p}, '[')) - 2"
    case = f"CASE WHEN c IS NULL THEN 'extra_decoded_record' WHEN d IS NULL THEN 'missing_decoded_record' WHEN {last('c')} <> {last('d')} THEN 'ts_ns' WHEN {levels('c')} <> {levels('d')} THEN 'field_count' WHEN {head('c')} <> {head('d')} THEN 'levels' END"
    return f"""pair AS (SELECT session_id, seq + 1 AS line_no, x.line AS c, y.line AS d FROM ({canonical}) x FULL JOIN ({decoded}) y USING (session_id, seq)), cmp AS MATERIALIZED (SELECT *, {case} AS field FROM pair)"""


def _bytes(canonical: str, decoded: str) -> str:
    """Both streams as one text a session, compared character by character."""
    chars = lambda t: f"SELECT session_id, unnest(string_split(t, '')) AS ch, unnest(range(length(t))) AS i FROM {t}"
    text = lambda q: f"SELECT session_id, string_agg(line || chr(10), '' ORDER BY seq) AS t, length(string_agg(line || chr(10), '' ORDER BY seq)) AS n FROM ({q}) GROUP BY session_id"
    cut = lambda t: f"CASE WHEN wrong IS NOT NULL OR d.n > c.n THEN replace(substr({t}, start + 1, least(32, (start // {BLOCK} + 1) * {BLOCK} - start)), chr(10), '.') ELSE '' END"
    return f"""ct AS MATERIALIZED ({text(canonical)}), dt AS MATERIALIZED ({text(decoded)}),
  wr AS (SELECT session_id, {_sum('CASE WHEN x.ch IS NULL OR y.ch IS NULL OR x.ch <> y.ch THEN 1 ELSE 0 END')} AS mismatch_bytes, min(CASE WHEN x.ch <> y.ch THEN i END) AS wrong
    FROM ({chars('ct')}) x FULL JOIN ({chars('dt')}) y USING (session_id, i) GROUP BY session_id),
  bs1 AS (SELECT session_id, coalesce(c.n, 0) AS canonical_bytes, coalesce(d.n, 0) AS decoded_bytes, least(coalesce(c.n, 0), coalesce(d.n, 0)) AS compared_bytes, mismatch_bytes,
      coalesce(wrong, CASE WHEN coalesce(c.n, 0) <> coalesce(d.n, 0) THEN least(coalesce(c.n, 0), coalesce(d.n, 0)) END, 0) AS first_mismatch_offset,
      CASE WHEN wrong IS NOT NULL OR d.n > c.n THEN 'byte' WHEN c.n <> d.n THEN 'length' END AS kind, {cut('c.t')} AS preview_canonical, {cut('d.t')} AS preview_decoded
    FROM (SELECT *, coalesce(wrong, least(cn, dn) // {BLOCK} * {BLOCK}) AS start FROM (SELECT w.*, a.n AS cn, b.n AS dn FROM wr w LEFT JOIN ct a USING (session_id) LEFT JOIN dt b USING (session_id))) LEFT JOIN ct c USING (session_id) LEFT JOIN dt d USING (session_id))"""


def _verified(mode: str = "both") -> str:
    by_byte, by_record = mode != "record", mode != "byte"
    time = r"CAST(trim(regexp_extract(d, '([0-9-]+)\s*\]$', 1)) AS BIGINT)"
    records = f"SELECT session_id, count(c) AS canonical_record_count, count(d) AS decoded_record_count, coalesce(max({time}) - min({time}), 0) AS replay_time_span_ns, count(field) = 0 AS record_exact, min(CASE WHEN field IS NOT NULL THEN line_no END) AS first_line, arg_min(field, line_no) FILTER (WHERE field IS NOT NULL) AS field FROM cmp GROUP BY session_id"
    byte = lambda c, zero="CAST(0 AS BIGINT)": c if by_byte else zero
    rec = lambda c, zero="CAST(0 AS BIGINT)": c if by_record else zero
    be, re_ = byte("mismatch_bytes = 0", "false"), rec("record_exact", "false")
    bad = f"({rec('NOT record_exact', 'false')} OR {byte('mismatch_bytes <> 0', 'false')})"
    return f"""SELECT session_id, {byte('canonical_bytes')} AS canonical_bytes, {byte('decoded_bytes')} AS decoded_bytes, {byte('compared_bytes')} AS compared_bytes, {byte('mismatch_bytes')} AS mismatch_bytes,
  {byte('100 * (CAST(mismatch_bytes AS DOUBLE) / CAST(greatest(canonical_bytes, decoded_bytes) AS DOUBLE))', 'CAST(0 AS DOUBLE)')} AS mismatch_percent, {be} AS byte_exact, {re_} AS record_exact,
  {rec('canonical_record_count')} AS canonical_record_count, {rec('decoded_record_count')} AS decoded_record_count, {rec('replay_time_span_ns')} AS replay_time_span_ns, {byte('first_mismatch_offset')} AS first_mismatch_offset,
  {rec('CAST(coalesce(first_line, 0) AS BIGINT)')} AS first_mismatch_line, coalesce({rec('field', 'NULL')}, {byte('kind', 'NULL')}, '') AS first_mismatch_field, {byte('preview_canonical', "''")} AS preview_canonical, {byte('preview_decoded', "''")} AS preview_decoded,
  CASE WHEN {bad} THEN 'verification_failed' ELSE 'ok' END AS status, CASE WHEN {rec('NOT record_exact', 'false')} THEN 'decoded records differ from canonical jsonl' WHEN {bad} THEN 'decoded bytes differ from canonical jsonl' ELSE '' END AS error, NOT {bad} AS verified
  FROM bs1 JOIN ({records}) USING (session_id)"""


def _fnv(values: str) -> str:
    return f"list_reduce(list_transform({values}, lambda v: v::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"


def _le(c: str) -> str:
    return f"list_transform(range(8), lambda k: CAST(({c} >> (8 * k)) & 255 AS BIGINT))"


def _signed(h: str) -> str:
    return f"CAST(CASE WHEN {h} >= 9223372036854775808::HUGEINT THEN {h} - 18446744073709551616::HUGEINT ELSE {h} END AS BIGINT)"


def _hashes(stream: str, source: str, text: str, name: str, fields: list[str]) -> str:
    """Sequential hashes by folds over the bytes of a session's lines and of its records."""
    name_bytes = "[" + ", ".join(str(b) for b in stream.encode()) + "]"
    if stream == "depth":
        level = f"list_concat(list_concat({_le('price_e8')}, {_le('qty_e8')}), {_le('side')})"
        rows = f"SELECT session_id, batch AS seq, min(ts_ns) AS ts, count(*) AS n, {_fnv(f'flatten(list({level} ORDER BY pos))')} AS own FROM levels GROUP BY session_id, batch"
        # The hash is unsigned: its bytes by division.
        own = "list_transform(range(8), lambda k: CAST((own // (CAST(1 AS HUGEINT) << (8 * k))) % 256 AS BIGINT))"
        record = f"flatten([{name_bytes}, {_le('ts')}, {_le('n')}, {own}, list_transform(range(8 * least(n, 8)), lambda k: CAST(0 AS BIGINT))])"
    else:
        table = "trades" if stream == "trades" else "book"
        rows = f"SELECT *, ts_ns AS ts FROM {table}"
        record = f"flatten([{name_bytes}, {_le('ts')}, {_le(f'CAST({len(fields)} AS BIGINT)')}, {', '.join(map(_le, fields))}])"
    return _q(
        f"SELECT session_id, {_signed('b')} AS byte_hash, {_signed('r')} AS record_hash FROM (SELECT session_id, {_fnv(chr(39).join(['list_transform(string_split(string_agg(line || chr(10), ', '', ' ORDER BY seq), ', '', '), lambda x: ascii(x))']))} AS b FROM {name} GROUP BY session_id)"
        f" JOIN (SELECT session_id, {_fnv('flatten(list(bytes ORDER BY seq))')} AS r FROM (SELECT session_id, seq, {record} AS bytes FROM ({rows})) GROUP BY session_id) USING (session_id)",
        source, text)


_TF, _BF = ["price_e8", "qty_e8", "side"], ["bid_price_e8", "bid_qty_e8", "ask_price_e8", "ask_qty_e8"]

_RUNS = """runs AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'std.zstd_jsonl_blocks_v1' ELSE 'std.gzip_jsonl_blocks_v1' END AS pipeline_id, ['trades', 'bookticker', 'depth'][o_orderkey % 3 + 1] AS stream,
    CASE WHEN o_orderkey % 11 = 0 THEN 'decode_error' ELSE 'ok' END AS status, o_orderkey * 1000 AS input_bytes, o_orderkey % 7 * 100 AS output_bytes, o_orderkey % 13 * 1000000 AS encode_ns, o_orderkey % 17 * 1000000 AS decode_ns FROM orders),
  latest AS (SELECT *, CASE WHEN output_bytes = 0 THEN 0.0 ELSE CAST(input_bytes AS DOUBLE) / CAST(output_bytes AS DOUBLE) END AS ratio,
    CASE WHEN encode_ns = 0 THEN 0.0 ELSE (CAST(input_bytes AS DOUBLE) / 1048576.0::DOUBLE) / (CAST(encode_ns AS DOUBLE) / 1e9) END AS encode_mb_per_sec,
    CASE WHEN decode_ns = 0 THEN 0.0 ELSE (CAST(input_bytes AS DOUBLE) / 1048576.0::DOUBLE) / (CAST(decode_ns AS DOUBLE) / 1e9) END AS decode_mb_per_sec
    FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline_id, stream ORDER BY k DESC) = 1)"""


def _values(rows: list[tuple], columns: list[str]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({', '.join(columns)})"


#: The catalogue written out by hand: one line for each block codec and stream, and rules for the rest.
_CATALOG = """WITH std(c, entropy, profile, availability, reason, slug, extension) AS (VALUES
    ('zstd', 'zstd', 'archive', 'available', '', 'zstd', '.hfc'), ('raw', 'none', 'research', 'available', '', 'raw-jsonl', '.hfr'),
    ('lz4', 'lz4', 'live', 'dependency_unavailable', 'lz4 module is not installed', 'lz4', '.hfc'), ('brotli', 'brotli', 'archive', 'dependency_unavailable', 'brotli module is not installed', 'brotli', '.hfc'),
    ('xz', 'xz', 'archive', 'available', '', 'xz', '.hfc'), ('gzip', 'gzip', 'archive', 'available', '', 'gzip', '.hfc')),
  tr(s, base, rep, transform, version, slug) AS (VALUES
    ('trades', 'trades_grouped_delta_qtydict', 'grouped_delta_qtydict', 'gcd_scaled_timestamp_price_groups_bitflags_pgc1_qtydict', 'math_v3', 'trades-grouped-delta-qtydict'),
    ('bookticker', 'bookticker_delta_mask', 'delta_mask', 'base_state_bid_spread_packed_change_mask_zigzag', 'v2', 'bookticker-delta-mask'),
    ('depth', 'depth_ladder_offset', 'ladder_offset', 'side_runs_first_offset_gaps_delete_side_hotqty', 'v3', 'depth-ladder-offset')),
  en(e) AS (VALUES ('ac16_ctx0'), ('ac16_ctx8'), ('ac16_ctx12'), ('ac32_ctx8'), ('range_byte_ctx8'), ('rans_byte_static')),
  sh(short, s) AS (VALUES ('trade', 'trades'), ('l1', 'bookticker'), ('depth', 'depth')),
  pl(kind, form, transform, entropy, profile, what) AS (VALUES ('delta_varint', 'delta', 'delta_varint', 'none', 'live', 'transform'), ('delta_zstd', 'delta', 'delta', 'zstd', 'archive', 'delta pipeline'),
    ('columnar_delta_zstd', 'columnar', 'columnar_delta', 'zstd', 'archive', 'columnar pipeline'), ('delta_lz4', 'delta', 'delta', 'lz4', 'live', 'lz4 pipeline'))
  SELECT 'std.' || c || '_jsonl_blocks_v1' AS pipeline_id, 'all' AS stream_scope, 'jsonl_blocks' AS representation, 'raw_jsonl' AS transform, entropy, profile, availability, reason, slug, extension FROM std
  UNION ALL SELECT 'tick.' || base || '_' || version, s, rep, transform, 'none', 'replay', 'available', '', slug || '-' || replace(version, '_', '-'), '.cxcef' FROM tr
  UNION ALL SELECT 'tick.' || base || '_' || e || '_v1', s, rep || '_entropy', transform, e, 'archive', 'available', '', slug || '-' || replace(e, '_', '-'), '.cxcef' FROM tr CROSS JOIN en
  UNION ALL SELECT 'py.' || c || '_jsonl_v1', 'all', 'jsonl_blocks', 'raw_jsonl', c, 'research', 'not_implemented', 'python lab runner is planned', 'py-' || c, '' FROM (VALUES ('zstandard'), ('lz4'), ('lzma')) v(c)
  UNION ALL SELECT short || '.' || kind || '_v1', s, short || '_' || form, transform, entropy, profile, 'not_implemented', short || ' ' || what || ' is planned', short || '-' || replace(kind, '_', '-'), '' FROM sh CROSS JOIN pl"""

_PROM = " UNION ALL ".join(
    [f"SELECT 'tape_run_{n}' || labels || CAST({e} AS VARCHAR) AS line FROM lab" for n, e in (
        ("success", "CASE WHEN status = 'ok' THEN 1 ELSE 0 END"), ("input_bytes", "input_bytes"), ("output_bytes", "output_bytes"), ("lines_total", "k"), ("blocks_total", "k % 5"), ("encode_ns", "encode_ns"),
        ("decode_ns", "decode_ns"), ("encode_cycles", "k * 3"), ("decode_cycles", "k * 2"), ("roundtrip_ok", "CASE WHEN k % 11 <> 0 THEN 1 ELSE 0 END"))]
    + [f"SELECT 'tape_run_{c}' || labels || printf('%.6f', {c}) AS line FROM lab" for c in ("ratio", "encode_mb_per_sec", "decode_mb_per_sec")]
)

_DIRTY = [
    ("trades", "[1,2,1,100]", 1, 1), ("trades", "[ 1 ,\t2, 0,100 ]\r", 1, 1), ("trades", "[1,2,2,100]", 0, 0), ("trades", "[1,2,1]", 0, 0), ("trades", "[1,2,1,100,5]", 0, 0), ("trades", "[1,2.5,1,100]", 0, 0),
    ("trades", '["1",2,1,100]', 0, 0), ("trades", "[1,2,1,100] x", 0, 0), ("trades", "", 0, 0), ("trades", "[+1,2,1,100]", 0, 0), ("trades", "[-1,2,1,100]", 1, 1), ("trades", "[9223372036854775808,2,1,100]", 0, 0), ("trades", "[01,2,1,100]", 0, 0),
    ("bookticker", "[100,10,110,20,1000]", 1, 1), ("bookticker", "[100,10,110,20]", 0, 0), ("bookticker", "[100,-10,110,20,1000]", 1, 1),
    ("depth", "[[100,10,0],[110,20,1],1000]", 1, 1), ("depth", "[123]", 0, 1), ("depth", "[]", 0, 0), ("depth", "[[100,10,2],1000]", 0, 0), ("depth", "[[[100,1,0,0]],[[101,2,1,0]],123]", 0, 0), ("depth", "[[100,10],1000]", 0, 0), ("depth", "[[100,0,0], [99,7,0],\t1002]", 1, 1),
]
_LD = "ld AS (SELECT session_id, batch AS seq, '[' || string_agg('[' || price_e8 || ',' || qty_e8 || ',' || side || ']', ',' ORDER BY pos) || ',' || min(ts_ns) || ']' AS line FROM levels GROUP BY session_id, batch)"
_ALL = [TRADES, _LT, BOOK, _LB, LEVELS, _LD]
# Every canonical line is valid by construction; what the dirty ones are is written beside them.
_STRICT = _q("SELECT 'dirty' AS origin, CAST(id AS BIGINT) AS id, stream, line, strict_ok = 1 AS strict_ok, zstd_ok = 1 AS zstd_ok FROM (" + _values([(i, *r) for i, r in enumerate(_DIRTY)], ["id", "stream", "line", "strict_ok", "zstd_ok"]) + ")"
             + "".join(f" UNION ALL SELECT session_id, seq, '{x}', line, true, true FROM {t}" for x, t in (("trades", "lt"), ("bookticker", "lb"), ("depth", "ld"))), *_ALL)

_LAY = f"""ly AS (SELECT session_id, seq, length(line) + 1 AS size, CAST(sum(length(line) + 1) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM lt),
  bl AS (SELECT session_id, e - size AS s, e, unnest(range((e - size) // {BLOCK}, (e - 1) // {BLOCK} + 1)) AS block FROM ly)"""
_CODEC = _q(" UNION ALL ".join(f"SELECT session_id || '/{x}' AS session_id, CAST((sum(length(line) + 1) + {BLOCK - 1}) // {BLOCK} AS BIGINT) AS block_count, {_sum('length(line) + 1')} AS input_bytes, count(*) AS line_count, true AS roundtrip_ok FROM {t} GROUP BY session_id" for x, t in (("trades", "lt"), ("bookticker", "lb"), ("depth", "ld"))), *_ALL)

ORACLE = {
    "trades_canonical": _q("SELECT * FROM lt", TRADES, _LT),
    "bookticker_canonical": _q("SELECT * FROM lb", BOOK, _LB),
    "depth_canonical": _q("SELECT session_id, batch AS seq, '[' || string_agg('[' || price_e8 || ',' || qty_e8 || ',' || side || ']', ',' ORDER BY pos) || ',' || min(ts_ns) || ']' AS line FROM levels GROUP BY session_id, batch", LEVELS),
    "trades_chunk_scales": _q("SELECT * FROM sc", *_TR),
    "trades_time_groups": _q("SELECT * FROM tgs", *_TR, RUNS, TG),
    "trades_price_groups": _q("SELECT * FROM pgs", *_TR, RUNS, PG),
    "trades_qty_histogram": _q("SELECT * FROM rk", *_TR, RK),
    "trades_hot_capacity_cost": _q("SELECT * FROM cost", *_TR, RK, COST),
    "trades_hot_capacity": _q("SELECT session_id, chunk, capacity, bits, hot, escapes, escape_bytes, cost FROM cap", *_TR, RK, COST),
    "trades_hot_dictionary": _q("SELECT * FROM dict", *_TR, RK, COST),
    "trades_qty_codes": _q("SELECT session_id, chunk, seq, coalesce(code, capacity) AS code, CASE WHEN code IS NULL THEN lot END AS escape_lot FROM lots JOIN (SELECT session_id, chunk, capacity FROM cap) USING (session_id, chunk) LEFT JOIN (SELECT session_id, chunk, lot, code FROM dict) USING (session_id, chunk, lot)", *_TR, RK, COST),
    "trades_stream_sizes": _q("SELECT * FROM sz", *_TR, RUNS, PG, TG, RK, COST, _SZ),
    "trades_stats": _q(
        "SELECT s.*, input_bytes, first_price_scale, first_qty_scale, first_time_scale, CAST(encoded_bytes AS DOUBLE) / record_count AS bytes_per_trade FROM (SELECT session_id, " + _sum("records") + " AS record_count, count(*) AS chunk_count, "
        + ", ".join(f"{_sum(c)} AS {c}" for c in ("time_groups", "price_groups", "qty_escapes", "dp_zero_count", "count_one_count", "price_group_count_one_count", "hot_table_bytes", "time_bytes", "price_bytes", "flag_bytes", "pgc1_bytes", "qty_code_bytes", "qty_escape_bytes"))
        + f", 96 + {_sum('payload_bytes + 160')} AS encoded_bytes FROM sz GROUP BY session_id) s JOIN (SELECT session_id, {_sum('length(line) + 1')} AS input_bytes FROM lt GROUP BY session_id) USING (session_id)"
        " JOIN (SELECT session_id, price_scale AS first_price_scale, qty_scale AS first_qty_scale, time_scale AS first_time_scale FROM sc WHERE chunk = 0) USING (session_id)",
        *_TR, RUNS, PG, TG, RK, COST, _SZ, _LT),
    "trades_decode_prefix_sum": _q("SELECT session_id, seq, price_e8, qty_e8, side, ts_ns FROM trades", TRADES),
    "trades_parse_roundtrip": _q("SELECT session_id, seq, price_e8, qty_e8, side, ts_ns FROM trades", TRADES),
    "trades_monotonic_check": _q(f"SELECT session_id, count(*) AS record_count, {_sum('CASE WHEN ts_ns < p OR price_e8 <= 0 OR qty_e8 <= 0 THEN 1 ELSE 0 END')} AS rejected FROM (SELECT *, lag(ts_ns) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM trades) GROUP BY session_id", TRADES),
    "bookticker_scales": _q("SELECT * FROM bsc", BOOK, BS),
    "bookticker_deltas": _q("SELECT * FROM bd", *_BB),
    "bookticker_masks": _q(f"SELECT session_id, seq, {_MASK} AS mask FROM bd WHERE seq > 0", *_BB),
    "bookticker_stats": _q(
        "SELECT *, 160 + time_bytes + mask_bytes + bid_bytes + spread_bytes + bid_qty_bytes + ask_qty_bytes AS encoded_bytes, CAST(160 + time_bytes + mask_bytes + bid_bytes + spread_bytes + bid_qty_bytes + ask_qty_bytes AS DOUBLE) / record_count AS bytes_per_record FROM ("
        f"SELECT session_id, count(*) AS record_count, {_sum(f'CASE WHEN seq > 0 AND {_MASK} <> 0 THEN 1 ELSE 0 END')} AS mask_nonzero, "
        + ", ".join(f"{_sum(f'CASE WHEN seq > 0 AND d_{c} <> 0 THEN 1 ELSE 0 END')} AS {c}_changed" for c in ("bid", "spread", "bid_qty", "ask_qty"))
        + f", {_sum('CASE WHEN seq > 0 THEN ' + _vl('d_t') + ' ELSE 0 END')} AS time_bytes, "
        + ", ".join(f"{_sum(f'CASE WHEN seq > 0 AND d_{c} <> 0 THEN {_vl(_zz(f'd_{c}'))} ELSE 0 END')} AS {c}_bytes" for c in ("bid", "spread", "bid_qty", "ask_qty"))
        + ", count(*) // 2 AS mask_bytes, count(*) * 40 AS raw_runtime_bytes FROM bd GROUP BY session_id)", *_BB),
    "bookticker_decode": _q("SELECT * FROM book", BOOK),
    "depth_exploded": _q(_LVL, LEVELS),
    "depth_parse_levels": _q(_LVL, LEVELS),
    "depth_scales": _q("SELECT * FROM dsc", LEVELS, DS),
    "depth_best_before": _q("SELECT * FROM best", LEVELS, BEST),
    "depth_offsets": _q('SELECT session_id, batch, pos, side, price_tick, best_tick, "offset" FROM ofs', *_DD),
    "depth_run_mode": _q("SELECT * FROM rm", *_DD, RM),
    "depth_offset_gaps": _q('SELECT session_id, batch, pos, side, "offset", gap FROM md WHERE run_mode = 1', *_DD),
    "depth_hot_by_side": _q("SELECT * FROM hot", LEVELS, HOT),
    "depth_stats": _q(_DEPTH_STATS, *_DD, RM, HOT),
    "depth_book_final": _q("SELECT session_id, side, price_e8, qty_e8 FROM levels QUALIFY row_number() OVER (PARTITION BY session_id, side, price_e8 ORDER BY batch DESC, pos DESC) = 1 AND qty_e8 <> 0", LEVELS),
    "jsonl_strict_validation": _STRICT,
    "blocks_layout": _q(f"SELECT session_id, block, min(greatest(s, block * {BLOCK})) AS first_byte_offset, {_sum(f'least(e, (block + 1) * {BLOCK}) - greatest(s, block * {BLOCK})')} AS uncompressed_bytes, {_sum(f'CASE WHEN (e - 1) // {BLOCK} = block THEN 1 ELSE 0 END')} AS line_count FROM bl GROUP BY session_id, block", TRADES, _LT, _LAY),
    "replay_batches": _q(f"SELECT session_id, seq // 4096 AS batch, count(*) AS record_count, min(seq) + 1 AS first_line_number, {_sum('length(line) + 1')} AS decoded_bytes FROM lt GROUP BY ALL", TRADES, _LT),
    "replay_time_span": _q("SELECT 'trades' AS stream, session_id, max(ts_ns) - min(ts_ns) AS time_span_ns FROM trades GROUP BY session_id UNION ALL SELECT 'bookticker', session_id, max(ts_ns) - min(ts_ns) FROM book GROUP BY session_id UNION ALL SELECT 'depth', session_id, max(ts_ns) - min(ts_ns) FROM levels GROUP BY session_id", TRADES, BOOK, LEVELS),
    "verify_records_exact": _q(_verified(), TRADES, _LT, _pairs("SELECT * FROM lt", "SELECT * FROM lt", _TF), _bytes("SELECT * FROM lt", "SELECT * FROM lt")),
    "verify_records_mutated": _q("SELECT session_id, line_no, field FROM cmp WHERE field IS NOT NULL", TRADES, _LT, _pairs("SELECT * FROM lt", f"SELECT session_id, seq, {_MUT} AS line FROM lt", _TF)),
    "verify_missing_extra": _q("SELECT session_id, field, count(*) AS n, min(line_no) AS first_line FROM cmp WHERE field IS NOT NULL GROUP BY ALL", BOOK, _LB, _pairs("SELECT * FROM lb", "SELECT * FROM lb WHERE seq % 97 <> 5 UNION ALL SELECT session_id, seq + 1000000, line FROM lb WHERE seq % 89 = 3", _BF)),
    "pipeline_catalog": _CATALOG,
    "pipeline_availability": f"SELECT availability, count(*) AS n FROM ({_CATALOG}) GROUP BY availability",
    "status_strings": "SELECT CAST(code - 1 AS BIGINT) AS code, status FROM (SELECT unnest(['ok', 'invalid_argument', 'io_error', 'unsupported_stream', 'unsupported_pipeline', 'dependency_unavailable', 'not_implemented', 'corrupt_data', 'decode_error', 'verification_failed', 'callback_stopped']) AS status, unnest(range(1, 12)) AS code)",
    "run_matrix_latest": _q("SELECT pipeline_id, stream, k AS run_no, status, input_bytes, output_bytes, round(ratio, 6) AS ratio, round(encode_mb_per_sec, 6) AS encode_mb_per_sec, round(decode_mb_per_sec, 6) AS decode_mb_per_sec FROM latest", _RUNS),
    "prometheus_lines": _q(_PROM, _RUNS, """lab AS (SELECT *, '{pipeline="' || pipeline_id || '",stream="' || stream || '"} ' AS labels FROM latest)"""),
    **{f"codec_roundtrip_{n}": _CODEC for n in ("zstd", "gzip", "xz", "bz2", "zlib", "raw")},
}

_TEXTS = {"trades": (TRADES, _LT, "lt"), "bookticker": (BOOK, _LB, "lb"), "depth": (LEVELS, _LD, "ld")}
for _stream, (_source, _text, _name) in _TEXTS.items():
    ORACLE[f"artifact_roundtrip_{_stream}"] = _q(f"SELECT session_id, seq, line FROM {_name}", _source, _text)
    for _p in PROFILES:
        ORACLE[f"entropy_roundtrip_{_p}_{_stream}"] = _q(f"SELECT session_id, count(*) AS line_count, {_sum('length(line) + 1')} AS input_bytes, true AS exact FROM {_name} GROUP BY session_id", _source, _text)
_FIELDS = {"trades": _TF, "bookticker": _BF, "depth": []}
for _stream, (_source, _text, _name) in _TEXTS.items():
    _a, _b = f"SELECT * FROM {_name}", f"SELECT session_id, seq, {_MUT} AS line FROM {_name}"
    ORACLE[f"verify_bytes_{_stream}"] = _q(_verified(), _source, _text, _depth_pairs(_a, _b) if _stream == "depth" else _pairs(_a, _b, _FIELDS[_stream]), _bytes(_a, _b))
    ORACLE[f"stream_hashes_{_stream}"] = _hashes(_stream, _source, _text, _name, _FIELDS[_stream])
_SHORT = "SELECT session_id, seq, line FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM lb) WHERE seq * 10 < n * 9"
ORACLE["verify_modes"] = _q(" UNION ALL ".join(f"SELECT *, '{m}' AS mode FROM ({_verified(m)})" for m in ("byte", "record", "both")), BOOK, _LB, _pairs("SELECT * FROM lb", _SHORT, _BF), _bytes("SELECT * FROM lb", _SHORT))
for _stream in _TEXTS:
    ORACLE[f"artifact_files_{_stream}"] = ORACLE[f"artifact_roundtrip_{_stream}"]
    ORACLE[f"container_roundtrip_{_stream}"] = ORACLE[f"artifact_roundtrip_{_stream}"]
_INDEX = _q(f"SELECT session_id, block, min(greatest(s, block * {BLOCK})) AS first_byte_offset, {_sum(f'least(e, (block + 1) * {BLOCK}) - greatest(s, block * {BLOCK})')} AS uncompressed_bytes, {_sum(f'CASE WHEN (e - 1) // {BLOCK} = block THEN 1 ELSE 0 END')} AS line_count FROM bl GROUP BY session_id, block", TRADES, _LT, _LAY)
ORACLE["container_block_index"] = f"SELECT session_id, 'trades' AS stream, 'zstd' AS codec, block, first_byte_offset, uncompressed_bytes, line_count FROM ({_INDEX}) WHERE block >= 1"
ORACLE["container_files"] = f"SELECT session_id, {_sum('uncompressed_bytes')} AS input_bytes, CAST(64 + sum(uncompressed_bytes + 32) AS BIGINT) AS output_bytes, {_sum('line_count')} AS line_count, count(*) AS block_count, {_sum('uncompressed_bytes')} AS head_input_bytes, {_sum('line_count')} AS head_line_count, count(*) AS head_block_count FROM ({_INDEX}) GROUP BY session_id"
ORACLE["container_replay"] = _q("SELECT session_id, seq // 4096 AS batch, count(*) AS record_count, min(seq) + 1 AS first_line_number, max(ts_ns) - min(ts_ns) AS span_ns FROM trades GROUP BY ALL", TRADES)
ORACLE["text_files"] = _q("SELECT session_id, 'bookticker' AS stream, seq + 1 AS line_no, line FROM lb", BOOK, _LB)
for _n in ("gzip", "bz2", "lzma", "zlib", "zstandard"):
    ORACLE[f"lab_roundtrip_{_n}"] = _q(f"SELECT session_id, 'bookticker' AS stream, 'ok' AS status, true AS byte_exact, true AS record_exact, CAST(0 AS BIGINT) AS mismatch_bytes, {_sum('length(line) + 1')} AS input_bytes, count(*) AS record_count FROM lb GROUP BY session_id", BOOK, _LB)
_PLAIN = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(p, chr(10), chr(13) || chr(10)) ELSE p END AS x FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '', 'g') AS p FROM documents)"
ORACLE["line_functions"] = f"""SELECT doc_id, CAST(len(string_split(x, chr(10))) - CASE WHEN x = '' OR ends_with(x, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
  CASE WHEN contains(x, chr(10)) AND ends_with(string_split(x, chr(10))[1], chr(13)) THEN 'crlf' ELSE 'lf' END AS line_ending,
  regexp_replace(substr(x, CAST(doc_id % 50 + 1 AS BIGINT), 32), '["\\\\]|[^\\x20-\\x7e]', '.', 'g') AS preview FROM ({_PLAIN})"""
_LAST = "last AS (SELECT *, CASE WHEN output_bytes = 0 THEN 0.0 ELSE CAST(input_bytes AS DOUBLE) / output_bytes END AS ratio, CASE WHEN encode_ns = 0 THEN 0.0 ELSE (CAST(input_bytes AS DOUBLE) / 1048576.0::DOUBLE) / (encode_ns / 1e9) END AS encode_mb_per_sec, CASE WHEN decode_ns = 0 THEN 0.0 ELSE (CAST(input_bytes AS DOUBLE) / 1048576.0::DOUBLE) / (decode_ns / 1e9) END AS decode_mb_per_sec FROM runs ORDER BY k DESC LIMIT 1)"
ORACLE["last_run_lines"] = _q(" UNION ALL ".join([f"SELECT 'tape_{n} ' || CAST({e} AS VARCHAR) AS line FROM last" for n, e in (
    ("last_run_success", "CASE WHEN status = 'ok' THEN 1 ELSE 0 END"), ("input_bytes", "input_bytes"), ("output_bytes", "output_bytes"), ("lines_total", "k"), ("blocks_total", "k % 5"), ("encode_ns", "encode_ns"), ("decode_ns", "decode_ns"), ("encode_cycles", "k * 3"), ("decode_cycles", "k * 2"))]
    + [f"SELECT 'tape_{c} ' || printf('%.6f', {c}) FROM last" for c in ("ratio", "encode_mb_per_sec", "decode_mb_per_sec")]), _RUNS, _LAST)
ORACLE["inspect_stats_view_trades"] = f"SELECT session_id, 'tick.trades_grouped_delta_qtydict_math_v3' AS pipeline_id, record_count, chunk_count, encoded_bytes, dp_zero_count FROM ({ORACLE['trades_stats']})"
ORACLE["inspect_stats_view_bookticker"] = f"SELECT session_id, 'tick.bookticker_delta_mask_v2' AS pipeline_id, record_count, encoded_bytes, raw_runtime_bytes FROM ({ORACLE['bookticker_stats']})"
ORACLE["inspect_stats_view_depth"] = f"SELECT session_id, 'tick.depth_ladder_offset_v3' AS pipeline_id, batch_count, level_count AS total_level_count, encoded_bytes, delete_count FROM ({ORACLE['depth_stats']})"
for _n, _stream, _id in PIPELINE_RUNS:
    _source, _text, _name = _TEXTS[_stream]
    ORACLE[f"pipeline_run_{_n}_{_stream}"] = _q(f"SELECT session_id, '{_id}' AS pipeline_id, count(*) AS line_count, {_sum('length(line) + 1')} AS input_bytes, 'ok' AS status, true AS byte_exact, true AS record_exact, count(*) AS decoded_record_count, {_sum('length(line) + 1')} AS decoded_bytes, CAST(0 AS BIGINT) AS mismatch_bytes, true AS verified FROM {_name} GROUP BY session_id", _source, _text)
ORACLE["inspect_trades"] = f"SELECT session_id, record_count, chunk_count, time_groups, price_groups, qty_escapes FROM ({ORACLE['trades_stats']})"
ORACLE["inspect_bookticker"] = f"SELECT session_id, record_count, encoded_bytes, mask_nonzero, time_bytes, mask_bytes, bid_bytes FROM ({ORACLE['bookticker_stats']})"
ORACLE["inspect_depth"] = f"SELECT session_id, batch_count, level_count, encoded_bytes, delete_count, run_mode_batches, price_bytes FROM ({ORACLE['depth_stats']})"
ORACLE["stream_book"] = ORACLE["depth_best_before"]
ORACLE["stream_delta"] = _q("SELECT session_id, seq, " + ", ".join(_D(c, c) for c in ("ts_ns", *_BF)) + " FROM book WINDOW w AS (PARTITION BY session_id ORDER BY seq)", BOOK)
