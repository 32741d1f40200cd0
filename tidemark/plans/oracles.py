"""DuckDB SQL with the results of the library's own queries, written apart from them."""

from __future__ import annotations

import itertools

TICKS = "ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id, 1000000 + value AS price FROM events)"
LENGTH, PLAY, HORIZON, CANDLE = 21_600_000_000, 10_800_000_000, 10_800_000_000, 3_600_000_000

ROUNDS = f"""{TICKS},
    rounds_raw AS (SELECT symbol, us // {LENGTH} AS round_num, arg_min(price, (us, event_id)) AS start_price, arg_max(price, (us, event_id)) AS end_price, count(*) AS n_ticks
                   FROM ticks GROUP BY ALL),
    rounds AS (SELECT symbol, round_num, round_num * {LENGTH} AS start_us, round_num * {LENGTH} + {PLAY} AS cutoff_us, (round_num + 1) * {LENGTH} AS end_us, start_price, end_price, n_ticks,
                      CASE WHEN end_price > start_price THEN 1 WHEN end_price < start_price THEN 2 ELSE 0 END AS win_side,
                      CASE WHEN end_price > start_price THEN 'UP' WHEN end_price < start_price THEN 'DOWN' ELSE 'UNRESOLVED' END AS raw_direction FROM rounds_raw)"""

CANDLES = f"""{TICKS},
    candles_all AS (SELECT symbol, us // {CANDLE} AS bucket, arg_min(price, (us, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (us, event_id)) AS c, count(*) AS n
                    FROM ticks GROUP BY ALL),
    candles AS (SELECT a.* FROM candles_all a JOIN (SELECT symbol, max(bucket) AS m FROM candles_all GROUP BY symbol) b ON a.symbol = b.symbol AND a.bucket < b.m)"""

SIGNATURES = f"""{CANDLES},
    c1 AS (SELECT *, lag(o) OVER w AS po, lag(c) OVER w AS pc, count(*) OVER (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS seen FROM candles
           WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
    c2 AS (SELECT *, CASE WHEN h - l < 1e-9 THEN 'doji' WHEN abs(c - o) / (h - l) < 0.10 THEN 'doji'
                          WHEN abs(c - o) / (h - l) > 0.85 THEN CASE WHEN c > o THEN 'marubozu_bull' ELSE 'marubozu_bear' END
                          WHEN (least(o, c) - l) / (h - l) > 0.55 AND abs(c - o) / (h - l) < 0.45 THEN 'hammer'
                          WHEN (h - greatest(o, c)) / (h - l) > 0.55 AND abs(c - o) / (h - l) < 0.45 THEN 'star'
                          WHEN po IS NOT NULL AND least(o, c) > least(po, pc) AND greatest(o, c) < greatest(po, pc) THEN 'inside'
                          WHEN c > o THEN 'body_bull' ELSE 'body_bear' END AS class,
                  row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS rn FROM c1),
    c3 AS (SELECT a.symbol, a.bucket, a.rn, max(b.h) AS hi, min(b.l) AS lo FROM c2 a JOIN c2 b ON a.symbol = b.symbol AND b.rn > a.rn - least(5, a.seen) AND b.rn <= a.rn GROUP BY ALL),
    c4 AS (SELECT a.symbol, a.bucket, coalesce(max(b.rn) FILTER (b.class <> a.class), 0) AS differs FROM c2 a JOIN c2 b ON a.symbol = b.symbol AND b.rn <= a.rn AND b.rn >= a.rn - 8 GROUP BY ALL),
    signatures AS (SELECT c2.symbol, c2.bucket, c, class,
                          CASE WHEN hi <= lo THEN 'mid' WHEN (c - lo) / (hi - lo) <= 0.33 THEN 'lo' WHEN (c - lo) / (hi - lo) >= 0.67 THEN 'hi' ELSE 'mid' END AS position,
                          CASE WHEN pc > po THEN 'U' WHEN pc < po THEN 'D' ELSE 'F' END AS prev_dir,
                          CAST(least(c2.rn - differs, 1 + least(6, seen - 2)) AS INTEGER) AS streak
                   FROM c2 JOIN c3 USING (symbol, bucket) JOIN c4 USING (symbol, bucket) WHERE seen >= 3),
    signed AS (SELECT *, 'cs:' || class || '_' || position || '_' || prev_dir || '_st' || least(streak - 1, 3) AS signature FROM signatures)"""

BASELINES = f"""{ROUNDS},
    resolved AS (SELECT symbol, round_num, win_side FROM rounds WHERE win_side IN (1, 2)),
    past AS (SELECT r.symbol, r.round_num, v.win_side, row_number() OVER (PARTITION BY r.symbol, r.round_num ORDER BY v.round_num DESC) AS k
             FROM rounds r LEFT JOIN resolved v ON v.symbol = r.symbol AND v.round_num < r.round_num),
    known AS (SELECT symbol, round_num, max(win_side) FILTER (k = 1) AS last, count(win_side) FILTER (k <= 20) AS n, count(*) FILTER (k <= 20 AND win_side = 1) AS up FROM past GROUP BY ALL),
    says AS (SELECT symbol, round_num, 'always_down' AS engine, 'DOWN' AS direction FROM known
             UNION ALL SELECT symbol, round_num, 'always_up', 'UP' FROM known
             UNION ALL SELECT symbol, round_num, 'last_continue', CASE last WHEN 1 THEN 'UP' WHEN 2 THEN 'DOWN' ELSE 'NO_SIGNAL' END FROM known
             UNION ALL SELECT symbol, round_num, 'last_reverse', CASE last WHEN 1 THEN 'DOWN' WHEN 2 THEN 'UP' ELSE 'NO_SIGNAL' END FROM known
             UNION ALL SELECT symbol, round_num, 'majority', CASE WHEN 2 * up > n THEN 'UP' WHEN 2 * up < n THEN 'DOWN' ELSE 'NO_SIGNAL' END FROM known)"""

STATS = """SELECT engine, count(*) AS total, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_incorrect, count(*) FILTER (correct IS NULL) AS n_pending
           FROM outcomes WHERE direction IN ('UP', 'DOWN') GROUP BY engine"""

WILSON_LOW = "greatest(0.0, ({p} + 3.8416 / (2 * {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n}))"
WILSON_HIGH = "least(1.0, ({p} + 3.8416 / (2 * {n}) + 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n}))"


def wilson(p: str, n: str) -> tuple[str, str]:
    return WILSON_LOW.format(p=p, n=n), WILSON_HIGH.format(p=p, n=n)


def verdict(up: str, n: str, least: int = 40) -> str:
    """Columns direction and confidence."""
    low, high = wilson(f"(CAST({up} AS DOUBLE) / nullif({n}, 0))", f"nullif({n}, 0)")
    return f"""CASE WHEN {n} >= {least} AND {low} > 0.5 THEN 'UP' WHEN {n} >= {least} AND {high} < 0.5 THEN 'DOWN' ELSE 'NO_SIGNAL' END AS direction,
               round(CASE WHEN {n} >= {least} AND {low} > 0.5 THEN {low} WHEN {n} >= {least} AND {high} < 0.5 THEN 1 - ({high}) END, 9) AS confidence"""


MESSAGES = """m AS (SELECT event_id, CASE WHEN user_id = 0 THEN 'ping' ELSE 'tick' END AS cmd, event_type AS symbol, value AS price, epoch_us(ts) // 1000 AS tick_ms, epoch_us(ts) // 1000 + user_id AS received_ms FROM events),
    judged AS (SELECT *, CASE WHEN cmd <> 'tick' THEN 'unknown_tick_cmd' WHEN symbol <> 'purchase' THEN 'wrong_tick_symbol' WHEN NOT (price > 100 AND price < 1e7) THEN 'implausible_tick_price'
                              WHEN NOT (tick_ms > 1577836800000 AND tick_ms < 4102444800000) THEN 'implausible_tick_timestamp' END AS reason FROM m)"""

# the staking rule's seven steps, one level of SQL each
_W = "(PARTITION BY symbol ORDER BY us, event_id)"
_STEP = """CASE WHEN p{b} IS NULL OR p{a} IS NULL OR p{b} = p{a} THEN s
             WHEN p{b} > p{a} THEN CASE WHEN len(s) < 2 THEN [1, 1, 2, 3] ELSE list_concat(s[2:len(s) - 1], [s[1] + s[len(s)]])[1:32] END
             ELSE CASE WHEN len(s) - 2 >= 2 THEN s[2:len(s) - 1] ELSE [1, 1, 2, 3] END END"""
LABOUCHERE = (
    f"{TICKS}, q0 AS (SELECT symbol, us, event_id, {', '.join(f'lag(price, {k}) OVER {_W} AS p{k}' for k in range(8))}, CAST([1, 1, 2, 3] AS BIGINT[]) AS s FROM ticks)"
    + "".join(f", q{i} AS (SELECT * REPLACE ({_STEP.format(a=8 - i, b=7 - i)} AS s) FROM q{i - 1})" for i in range(1, 8))
)

def _dwell(core: str, rows: str, back: int, tag: str = "") -> str:
    """CTE ``binned{tag}``: rows with dwell_bin, from the newest row among the last ``back`` whose successor on has one core."""
    return f"""numbered{tag} AS (SELECT *, row_number() OVER {_W} AS rn FROM {rows}),
    last_other{tag} AS (SELECT a.symbol, a.rn, max(b.rn) FILTER (b.{core} IS DISTINCT FROM a.{core}) AS other, min(b.rn) AS oldest
                   FROM numbered{tag} a JOIN numbered{tag} b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - {back - 1} AND a.rn GROUP BY ALL),
    dwelt{tag} AS (SELECT a.*, (a.us - s.us) / 1e6 AS held FROM numbered{tag} a JOIN last_other{tag} o ON o.symbol = a.symbol AND o.rn = a.rn
              JOIN numbered{tag} s ON s.symbol = a.symbol AND s.rn = coalesce(o.other + 1, o.oldest)),
    binned{tag} AS (SELECT *, CASE WHEN held < 1440 THEN 0 WHEN held < 5760 THEN 1 WHEN held < 14400 THEN 2 ELSE 3 END AS dwell_bin FROM dwelt{tag})"""


def _speed(*features: str) -> str:
    """How fast features have moved since the fourth tick before, as a bin."""
    moved = " + ".join(f"abs({f} - lag({f}, 4) OVER {_W})" for f in features)
    speed = f"CASE WHEN us - lag(us, 4) OVER {_W} > 0 THEN ({moved}) / ((us - lag(us, 4) OVER {_W}) / 1e6) END"
    return f"CASE WHEN {speed} >= 0.30 / 720 THEN 2 WHEN {speed} >= 0.05 / 720 THEN 1 ELSE 0 END"


def _after_ticks(ctes: str) -> str:
    """The CTEs without the first one, which all of them share."""
    return ctes.removeprefix(TICKS).lstrip(" ,\n")


CRT = f"""{TICKS}, crt_v AS (SELECT symbol, us, event_id, CAST(trunc(price * 100000) AS BIGINT) % 1001 AS v FROM ticks),
    crt_r AS (SELECT symbol, us, event_id, 'crt:' || v % 7 || '-' || v % 11 || '-' || v % 13 AS core FROM crt_v), {_dwell("core", "crt_r", 15, "_crt")},
    crt_signed AS (SELECT symbol, us, event_id, core, dwell_bin, core || '_dw' || dwell_bin AS signature FROM binned_crt)"""

STAKED = f"""{LABOUCHERE},
    lab_r AS (SELECT symbol, us, event_id, len(s) AS n, list_sum(s) AS total, CASE WHEN p1 IS NOT NULL THEN 'lab:' || CASE WHEN p0 > p1 THEN 'win' WHEN p0 < p1 THEN 'loss' ELSE 'flat' END || ':len' || len(s) || '_sum' || CAST(list_sum(s) AS BIGINT) END AS core FROM q7),
    lab_v AS (SELECT *, {_speed("n", "total")} AS velocity_bin FROM lab_r), {_dwell("core", "lab_v", 12, "_lab")},
    lab_signed AS (SELECT symbol, us, event_id, core || '_dw' || dwell_bin || '_v' || velocity_bin AS signature FROM binned_lab)"""

ENTROPIES = f"""{TICKS}, ent_w AS (SELECT symbol, us, event_id, price, list(price) OVER (PARTITION BY symbol ORDER BY us, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS p FROM ticks),
    ent_pat AS (SELECT *, [CASE WHEN p[i] <= p[i + 1] THEN 4 ELSE 0 END + CASE WHEN p[i] <= p[i + 2] THEN 2 ELSE 0 END + CASE WHEN p[i + 1] <= p[i + 2] THEN 1 ELSE 0 END FOR i IN range(1, len(p) - 1)] AS o,
                   [ln(p[i]) - ln(p[i - 1]) FOR i IN range(2, len(p) + 1)] AS r FROM ent_w),
    ent_b AS (SELECT *, [least(CAST(trunc((x - list_min(r)) / (list_max(r) - list_min(r)) * 8) AS BIGINT), 7) FOR x IN r] AS rb FROM ent_pat WHERE len(p) >= 4),
    ent_h AS (SELECT symbol, us, event_id, [len(list_filter(o, lambda x: x = k)) FOR k IN range(8)] AS po, [len(list_filter(rb, lambda x: x = k)) FOR k IN range(8)] AS ro, len(o) AS no, len(r) AS nr, list_max(r) > list_min(r) AS moves FROM ent_b),
    ent AS (SELECT t.symbol, t.us, t.event_id, t.price, list_sum([CASE WHEN c > 0 THEN -(c / no) * ln(c / no) ELSE 0.0 END FOR c IN po]) / ln(6) AS pe,
                   CASE WHEN moves THEN list_sum([CASE WHEN c > 0 THEN -(c / nr) * ln(c / nr) ELSE 0.0 END FOR c IN ro]) / ln(8) WHEN moves IS NOT NULL THEN 0.0 END AS re
            FROM ticks t LEFT JOIN ent_h USING (symbol, us, event_id))"""

_QUARTER = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} >= 1 THEN 3 ELSE CAST(trunc({0} * 4) AS INTEGER) END"
ENTROPY_SIGNED = f"""{ENTROPIES},
    ent_n AS (SELECT *, row_number() OVER {_W} AS seen, lag(price) OVER {_W} AS before, {_speed("pe", "re")} AS velocity_bin FROM ent),
    ent_r AS (SELECT symbol, us, event_id, velocity_bin, CASE WHEN seen >= 8 THEN 'ent:p' || {_QUARTER.format("pe")} || '_r' || {_QUARTER.format("re")} || '_d' || CASE WHEN price > before THEN 'U' WHEN price < before THEN 'D' ELSE 'F' END END AS core FROM ent_n),
    {_dwell("core", "ent_r", 10, "_ent")},
    ent_signed AS (SELECT symbol, us, event_id, core, core || '_dw' || dwell_bin || '_v' || velocity_bin AS signature FROM binned_ent)"""

# what the engines say at every cutoff: their newest signature, and what had followed it by then
DIRECTED = f"""{BASELINES}, {_after_ticks(CRT)}, {_after_ticks(STAKED)}, {_after_ticks(ENTROPY_SIGNED)}, {_after_ticks(SIGNATURES)},
    facts AS (SELECT 'crt' AS engine, symbol, us, event_id, signature FROM crt_signed UNION ALL SELECT 'labouchere', symbol, us, event_id, signature FROM lab_signed
              UNION ALL SELECT 'entropy_regime', symbol, us, event_id, signature FROM ent_signed UNION ALL SELECT 'candlestick', symbol, (bucket + 1) * {CANDLE}, bucket, signature FROM signed),
    newest AS (SELECT engine, symbol, us, arg_max(signature, event_id) AS signature FROM facts WHERE signature IS NOT NULL GROUP BY ALL),
    asked AS (SELECT symbol, round_num, cutoff_us AS at_us, cutoff_us + {HORIZON} AS target_us, e.engine FROM rounds, (SELECT unnest(['crt', 'labouchere', 'entropy_regime', 'candlestick']) AS engine) e),
    states AS (SELECT a.symbol, a.round_num, a.at_us, a.target_us, a.engine, n.signature FROM asked a ASOF LEFT JOIN newest n ON n.engine = a.engine AND n.symbol = a.symbol AND a.at_us >= n.us),
    keyed AS (SELECT symbol, us, arg_max(price, event_id) AS price FROM ticks GROUP BY ALL),
    firsts AS (SELECT symbol, us, arg_min(price, event_id) AS price FROM ticks GROUP BY ALL),
    priced AS (SELECT r.symbol, r.round_num, r.cutoff_us AS at_us, r.cutoff_us + {HORIZON} AS target_us, a.price AS price_then, coalesce(b.price, f.price) AS actual_price
               FROM rounds r ASOF LEFT JOIN keyed a ON a.symbol = r.symbol AND r.cutoff_us >= a.us
               ASOF LEFT JOIN keyed b ON b.symbol = r.symbol AND r.cutoff_us + {HORIZON} >= b.us
               ASOF LEFT JOIN firsts f ON f.symbol = r.symbol AND r.cutoff_us + {HORIZON} < f.us),
    moved AS (SELECT *, CASE WHEN actual_price > price_then THEN 'UP' WHEN actual_price < price_then THEN 'DOWN' WHEN actual_price = price_then THEN 'FLAT' END AS result FROM priced),
    labels AS (SELECT s.engine, s.signature, s.symbol, s.round_num, s.target_us, m.result FROM states s JOIN moved m USING (symbol, round_num) WHERE s.signature IS NOT NULL AND m.result IN ('UP', 'DOWN')),
    recalled AS (SELECT s.symbol, s.round_num, s.at_us, s.engine, s.signature, l.result, row_number() OVER (PARTITION BY s.symbol, s.round_num, s.engine ORDER BY l.target_us DESC, l.symbol DESC, l.round_num DESC) AS k
                 FROM states s LEFT JOIN labels l ON l.engine = s.engine AND l.signature = s.signature AND l.target_us <= s.at_us),
    counted AS (SELECT symbol, round_num, at_us, engine, signature, count(result) FILTER (k <= 50) AS n_seen, count(*) FILTER (k <= 50 AND result = 'UP') AS up_seen FROM recalled GROUP BY ALL),
    directed AS (SELECT *, {verdict("up_seen", "n_seen")} FROM counted)"""

# atoms of the states, by kind, with their order of choice
ATOMS = f"""{DIRECTED},
    parsed AS (SELECT *, string_split(signature[strpos(signature, ':') + 1:], '_') AS ps FROM directed WHERE signature IS NOT NULL),
    listed AS (SELECT symbol, round_num, engine, direction, signature,
        list_concat([['namespace', split_part(signature, ':', 1)]], CASE engine
            WHEN 'crt' THEN [['a', split_part(ps[1], '-', 1)], ['b', split_part(ps[1], '-', 2)], ['c', split_part(ps[1], '-', 3)],
                 ['sum', CAST(CAST(split_part(ps[1], '-', 1) AS INT) + CAST(split_part(ps[1], '-', 2) AS INT) + CAST(split_part(ps[1], '-', 3) AS INT) AS VARCHAR)],
                 ['repeated', CASE WHEN len(list_distinct(string_split(ps[1], '-'))) < 3 THEN 'true' ELSE 'false' END], ['dw', ps[2][3:]]]
            WHEN 'labouchere' THEN [['result', ps[1]], ['sum', ps[2][4:]], ['dw', ps[3][3:]], ['v', ps[4][2:]]]
            WHEN 'entropy_regime' THEN [['p', ps[1][2:]], ['r', ps[2][2:]], ['d', ps[3][2:]], ['dw', ps[4][3:]], ['v', ps[5][2:]]]
            ELSE list_concat([['part' || (i - 1), ps[i]] FOR i IN range(1, len(ps) + 1)], [['form', CASE WHEN list_contains(ps, 'body') THEN 'body' ELSE ps[1] END],
                 ['dircode', CASE WHEN ps[2] IN ('mid', 'bull', 'bear', 'hi', 'lo') THEN ps[2] WHEN list_contains(ps, 'mid') THEN 'mid' END], ['st', ps[len(ps)][3:]],
                 ['candle_dir', CASE WHEN ps[len(ps) - 1] IN ('D', 'U') THEN ps[len(ps) - 1] END]]) END) AS fs FROM parsed),
    spread AS (SELECT symbol, round_num, engine, unnest(fs) AS f FROM listed),
    atoms AS (SELECT symbol, round_num, 'exact_signature' AS kind, engine, 'signature' AS feature, 'sig.' || engine || '=' || signature AS atom, 0 AS rank, 0 AS prio FROM listed
              UNION ALL SELECT symbol, round_num, 'direction', engine, 'direction', 'dir.' || engine || '=' || direction, 1, 0 FROM listed WHERE direction <> 'NO_SIGNAL'
              UNION ALL SELECT DISTINCT symbol, round_num, 'structural', engine, f[1], 'feat.' || engine || '.' || f[1] || '=' || f[2], 2,
                        CASE WHEN f[1] IN ('dw', 'a', 'b', 'c') THEN -90 WHEN f[1] = 'form' THEN -88 WHEN f[1] IN ('sum', 'p', 'dircode') THEN -85 WHEN f[1] IN ('repeated', 'v') THEN -80
                             WHEN f[1] = 'r' THEN -75 WHEN f[1] IN ('namespace', 'result') THEN -20 ELSE -10 END FROM spread WHERE f[2] IS NOT NULL),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY symbol, round_num ORDER BY rank, prio, engine, atom) AS k FROM atoms),
    selected AS (SELECT symbol, round_num, list(atom ORDER BY atom) AS atoms FROM chosen WHERE k <= 28 GROUP BY ALL)"""

STATE_PAIRS = f"""{ATOMS},
    following AS (SELECT symbol, round_num, lead(raw_direction) OVER (PARTITION BY symbol ORDER BY round_num) AS next_outcome FROM rounds),
    paired AS (SELECT s.atoms[i] AS a, s.atoms[j] AS b, next_outcome FROM selected s JOIN following USING (symbol, round_num), range(1, 29) x(i), range(1, 29) y(j)
               WHERE i < j AND j <= len(s.atoms) AND next_outcome IN ('UP', 'DOWN')),
    support AS (SELECT CAST(to_json([a, b]) AS VARCHAR) AS key, count(*) AS n, count(*) FILTER (next_outcome = 'UP') AS up, count(*) FILTER (next_outcome = 'DOWN') AS down FROM paired GROUP BY ALL)"""

_SETS = [list(c) for size in (2, 3, 4) for c in itertools.combinations(range(1, 6), size)]
CANDLE_SETS = f"""{SIGNATURES},
    after AS (SELECT *, lead(c) OVER w AS next_c, lead(bucket) OVER w AS next_bucket FROM signed WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
    seen AS (SELECT symbol, bucket, (bucket + 1) * {CANDLE} AS us, (next_bucket + 1) * {CANDLE} AS label_us, CASE WHEN next_c > c THEN 'UP' WHEN next_c < c THEN 'DOWN' END AS next_outcome,
                    list_sort(['feat.symbol=' || symbol, 'feat.class=' || class, 'feat.position=' || position, 'feat.prev_dir=' || prev_dir, 'feat.streak=' || streak]) AS atoms FROM after),
    sets AS (SELECT symbol, bucket, us, label_us, next_outcome, len(i) AS size, [atoms[k] FOR k IN i] AS s, CAST(to_json([atoms[k] FOR k IN i]) AS VARCHAR) AS key FROM seen, (SELECT unnest({_SETS}) AS i) x)"""

RECORDED = f"""{_after_ticks(CRT)}, {_after_ticks(STAKED)},
    keyed AS (SELECT symbol, us, arg_max(price, event_id) AS price FROM ticks GROUP BY ALL),
    moved AS (SELECT t.symbol, t.us, t.event_id, CASE WHEN k.price > t.price THEN 'UP' WHEN k.price < t.price THEN 'DOWN' ELSE 'FLAT' END AS result
              FROM ticks t ASOF JOIN keyed k ON k.symbol = t.symbol AND t.us + {HORIZON} >= k.us),
    says AS (SELECT symbol, us, event_id, signature FROM crt_signed UNION ALL SELECT symbol, us, event_id, signature FROM lab_signed),
    observed AS (SELECT signature, us, event_id, us + {HORIZON} AS label_us, result FROM says JOIN moved USING (symbol, us, event_id) WHERE signature IS NOT NULL)"""
RESIDUES = f"{TICKS}, {RECORDED}"

OUTCOMES = f"""{DIRECTED},
    spoken AS (SELECT symbol, round_num, engine, direction FROM says UNION ALL SELECT symbol, round_num, engine, direction FROM directed),
    judged AS (SELECT spoken.*, at_us, target_us, price_then, actual_price, actual_price - price_then AS moved, result AS actual_direction FROM spoken JOIN moved USING (symbol, round_num)),
    outcomes AS (SELECT *, CASE WHEN direction IN ('UP', 'DOWN') AND actual_direction IS NOT NULL THEN direction = actual_direction END AS correct FROM judged)"""

# every round's combination of what the column engines say
COMBINED = """combined AS (SELECT symbol, round_num, moved.at_us, moved.target_us, result, string_agg(engine || ':' || direction, '|' ORDER BY engine || ':' || direction) AS combination
              FROM directed JOIN moved USING (symbol, round_num) GROUP BY ALL)"""

# a walk over each window's candles, one a step, that carries the averages; the last 13 steps give the cores that dwell looks at
MOMENTUM = f"""{CANDLES},
    k0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS rn, c - lag(c) OVER (PARTITION BY symbol ORDER BY bucket) AS d, (h + l + c) / 3 AS typ FROM candles),
    k1 AS (SELECT *, count(*) OVER w AS seen, sum(n) OVER w AS n_seen FROM k0 WINDOW w AS (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN 119 PRECEDING AND CURRENT ROW)),
    cm AS (SELECT a.symbol, a.rn, avg(b.typ) AS m FROM k0 a JOIN k0 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 29 AND a.rn GROUP BY ALL),
    cs AS (SELECT a.symbol, a.rn, any_value(a.m) AS m, avg(abs(b.typ - a.m)) AS dev FROM cm a JOIN k0 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 29 AND a.rn GROUP BY ALL),
    k2 AS (SELECT k1.*, CASE WHEN dev <= 1e-12 THEN 0.0 ELSE (typ - m) / (0.015 * dev) END AS cci FROM k1 JOIN cs USING (symbol, rn)),
    walk AS (
        SELECT symbol, bucket, rn, seen, 0 AS j, k.c0 AS f, k.c0 AS s, CAST(0 AS DOUBLE) AS sig, CAST(0 AS DOUBLE) AS hist, CAST(NULL AS DOUBLE) AS before, CAST(0 AS DOUBLE) AS gl, CAST(0 AS DOUBLE) AS ll, CAST(0 AS DOUBLE) AS gn, CAST(0 AS DOUBLE) AS ln, CAST([] AS DOUBLE[]) AS rs
        FROM (SELECT a.symbol, a.bucket, a.rn, a.seen, b.c AS c0 FROM k2 a JOIN k2 b ON b.symbol = a.symbol AND b.rn = a.rn - a.seen + 1 WHERE a.seen >= 90 AND a.n_seen >= 200) k
        UNION ALL
        SELECT symbol, bucket, rn, seen, j, f, s, sig, f - s - sig, before, gl, ll, gn, ln, CASE WHEN j >= 30 THEN list_append(rs[greatest(1, len(rs) - 28):], CASE WHEN ln <= 1e-12 THEN 100.0 ELSE 100 - 100 / (1 + gn / ln) END) ELSE rs END
        FROM (SELECT w.symbol, w.bucket, w.rn, w.seen, w.j + 1 AS j, k.c * 2 / 31 + w.f * 29 / 31 AS f, k.c * 2 / 61 + w.s * 59 / 61 AS s, (k.c * 2 / 31 + w.f * 29 / 31 - k.c * 2 / 61 - w.s * 59 / 61) * 2 / 21 + w.sig * 19 / 21 AS sig, w.hist AS before,
                     CASE WHEN w.j < 60 THEN w.gl + greatest(k.d, 0) / 60 ELSE (w.gl * 59 + greatest(k.d, 0)) / 60 END AS gl, CASE WHEN w.j < 60 THEN w.ll + greatest(-k.d, 0) / 60 ELSE (w.ll * 59 + greatest(-k.d, 0)) / 60 END AS ll,
                     CASE WHEN w.j < 30 THEN w.gn + greatest(k.d, 0) / 30 ELSE (w.gn * 29 + greatest(k.d, 0)) / 30 END AS gn, CASE WHEN w.j < 30 THEN w.ln + greatest(-k.d, 0) / 30 ELSE (w.ln * 29 + greatest(-k.d, 0)) / 30 END AS ln, w.rs
              FROM walk w JOIN k0 k ON k.symbol = w.symbol AND k.rn = w.rn - w.seen + 2 + w.j WHERE w.j + 1 < w.seen) x),
    felt AS (SELECT w.symbol, w.bucket, w.seen - 1 - w.j AS back, CASE WHEN ll <= 1e-12 THEN 100.0 ELSE 100 - 100 / (1 + gl / ll) END AS rsi, hist, before,
                    CASE WHEN list_max(rs) - list_min(rs) <= 1e-9 THEN 50.0 ELSE (rs[len(rs)] - list_min(rs)) / (list_max(rs) - list_min(rs)) * 100 END AS stochastic, k.cci AS channel
             FROM walk w JOIN k2 k ON k.symbol = w.symbol AND k.rn = w.rn - w.seen + 1 + w.j WHERE w.j >= w.seen - 13 AND w.j >= 89),
    cored AS (SELECT *, 'mom:r' || CASE WHEN rsi < 30 THEN 0 WHEN rsi < 50 THEN 1 WHEN rsi < 70 THEN 2 ELSE 3 END || '_m' || CASE WHEN hist > 0 AND hist >= before THEN 0 WHEN hist > 0 THEN 1 WHEN hist < 0 AND hist <= before THEN 2 ELSE 3 END
                     || '_s' || CASE WHEN stochastic < 20 THEN 0 WHEN stochastic < 80 THEN 1 ELSE 2 END || '_c' || CASE WHEN channel < -100 THEN 0 WHEN channel < 100 THEN 1 ELSE 2 END AS core FROM felt),
    held AS (SELECT a.*, coalesce((SELECT min(b.back) - 1 FROM cored b WHERE b.symbol = a.symbol AND b.bucket = a.bucket AND b.core <> a.core), (SELECT max(b.back) FROM cored b WHERE b.symbol = a.symbol AND b.bucket = a.bucket)) AS k
             FROM cored a WHERE a.back = 0),
    mom_signed AS (SELECT *, core || '_dw' || CASE WHEN k * 3600 < 1440 THEN 0 WHEN k * 3600 < 5760 THEN 1 WHEN k * 3600 < 14400 THEN 2 ELSE 3 END AS signature FROM held)"""

# every engine's history at every cutoff: hits of the latest 300 settled rounds, accuracies over 100 of them, and Holt's smoothing step by step
WEIGHED = f"""{OUTCOMES},
    settled AS (SELECT symbol, round_num, target_us, result, row_number() OVER (ORDER BY target_us, symbol, round_num) AS r FROM moved WHERE result IN ('UP', 'DOWN')),
    so_far AS (SELECT m.symbol, m.round_num, count(s.r) AS r FROM moved m LEFT JOIN settled s ON s.target_us <= m.at_us GROUP BY ALL),
    hits AS (SELECT p.engine, s.r, CASE WHEN p.direction = s.result THEN 1 ELSE 0 END AS hit FROM spoken p JOIN settled s USING (symbol, round_num) WHERE p.direction <> 'NO_SIGNAL'),
    history AS (SELECT p.engine, p.symbol, p.round_num, list(h.hit ORDER BY h.r) AS h FROM spoken p JOIN so_far f USING (symbol, round_num) JOIN hits h ON h.engine = p.engine AND h.r > f.r - 300 AND h.r <= f.r
             WHERE p.direction <> 'NO_SIGNAL' GROUP BY ALL),
    series AS (SELECT *, [list_sum(h[i - 99:i]) / 100.0 FOR i IN range(100, len(h) + 1)] AS a FROM history),
    walk(engine, symbol, round_num, a, k, level, slope) AS (
        SELECT engine, symbol, round_num, a, 1, CAST(a[1] AS DOUBLE), CAST(a[2] - a[1] AS DOUBLE) FROM series WHERE len(a) >= 5
        UNION ALL SELECT engine, symbol, round_num, a, k + 1, 0.3 * a[k + 1] + 0.7 * (level + slope), 0.1 * (0.3 * a[k + 1] + 0.7 * (level + slope) - level) + 0.9 * slope FROM walk WHERE k < len(a)),
    judged_w AS (SELECT engine, symbol, round_num, a[len(a)] AS accuracy, list_avg(a) - 2 * sqrt(list_var_samp(a)) AS lower_band, slope FROM walk WHERE k = len(a)),
    scored AS (SELECT p.symbol, p.round_num, p.engine, p.direction, coalesce(len(h), 0) AS n_history, accuracy, lower_band, slope, exp(4 * (accuracy - 0.5)) * CASE WHEN slope >= 0 THEN 1 ELSE greatest(0.3, 1 + 10 * slope) END AS w
               FROM spoken p LEFT JOIN history USING (engine, symbol, round_num) LEFT JOIN judged_w USING (engine, symbol, round_num)),
    weighed AS (SELECT *, CASE WHEN direction = 'NO_SIGNAL' THEN 'silent' WHEN n_history < 30 THEN 'insufficient history' WHEN accuracy IS NULL THEN 'accuracy series too short'
                               WHEN accuracy < lower_band - 1e-12 THEN 'below lower band' WHEN w < 0.05 THEN 'weight too small' END AS reason FROM scored)"""

PROJECTILE = f"""{_after_ticks(ROUNDS)},
    pj AS (SELECT r.symbol, r.round_num, t.us, t.event_id, t.price FROM rounds r JOIN ticks t ON t.symbol = r.symbol AND t.us BETWEEN start_us AND cutoff_us),
    pf AS (SELECT symbol, round_num, arg_min(price, (us, event_id)) AS p0, min(us) AS t0, count(*) AS n FROM pj GROUP BY ALL),
    px AS (SELECT symbol, round_num, us, event_id, n, p0, (us - t0) / 1e6 / 10800 AS t, (price - p0) / (p0 * 0.001) AS y FROM pj JOIN pf USING (symbol, round_num) WHERE n >= 3),
    pv AS (SELECT *, greatest((t - lag(t) OVER w) * 10800, 1e-9) AS dt, (y - lag(y) OVER w) / greatest((t - lag(t) OVER w) * 10800, 1e-9) AS v FROM px WINDOW w AS (PARTITION BY symbol, round_num ORDER BY us, event_id)),
    pa AS (SELECT *, (v - lag(v) OVER (PARTITION BY symbol, round_num ORDER BY us, event_id)) / dt AS acc FROM pv),
    pm AS (SELECT symbol, round_num, n, avg(t) AS mt, avg(t * t) AS mq, avg(y) AS my, arg_max(y, (us, event_id)) AS y_now, any_value(p0) AS p0, CASE WHEN max(n) >= 4 THEN coalesce(stddev_pop(acc), 0) ELSE 0 END AS spread FROM pa GROUP BY symbol, round_num, n),
    ps AS (SELECT px.symbol, px.round_num, sum((t - mt) * (t - mt)) AS tt, sum((t - mt) * (t * t - mq)) AS tq, sum((t - mt) * (y - my)) AS ty, sum((t * t - mq) * (t * t - mq)) AS qq,
                  sum((t * t - mq) * (y - my)) AS qy, sum((y - my) * (y - my)) AS yy FROM px JOIN pm USING (symbol, round_num) GROUP BY ALL),
    pc AS (SELECT *, (qy - tq / tt * ty) / (qq - tq / tt * tq) AS c2 FROM ps JOIN pm USING (symbol, round_num)), pd AS (SELECT *, (ty - c2 * tq) / tt AS c1 FROM pc), pe AS (SELECT *, my - c1 * mt - c2 * mq AS c0 FROM pd),
    pk AS (SELECT *, exp(-5 * (sqrt(CASE WHEN n = 3 THEN 0 ELSE greatest(0.0, yy - c1 * ty - c2 * qy) END / n) + spread)) * CASE WHEN c2 < 0 THEN 1 ELSE 0.5 END AS consistency,
                  CASE WHEN 2 * c2 / (10800.0 * 10800) < -1e-9 AND c1 > 0 THEN c0 - c1 * c1 / (4 * c2) END AS top, c0 + c1 + c2 - y_now AS delta FROM pe),
    thrown AS (SELECT *, 'proj:a' || CASE WHEN c1 < -1 THEN 0 WHEN c1 < -0.2 THEN 1 WHEN c1 < 0.2 THEN 2 WHEN c1 < 1 THEN 3 ELSE 4 END || '_c' || CASE WHEN round(consistency, 9) < 0.2 THEN 0 WHEN round(consistency, 9) < 0.5 THEN 1 WHEN round(consistency, 9) < 0.75 THEN 2 ELSE 3 END
                      || '_h' || CASE WHEN top IS NULL THEN 0 WHEN top < 0.5 THEN 1 WHEN top < 2 THEN 2 ELSE 3 END AS signature,
                      CASE WHEN delta > 1e-4 THEN 'UP' WHEN delta < -1e-4 THEN 'DOWN' END AS own, p0 + (c0 + c1 + c2) * p0 * 0.001 AS expected FROM pk)"""

_FLOW = ("velocity", "acceleration", "jerk", "curvature", "diffusion", "terrain_volatility", "path_signed", "path_absolute", "flow_inertia", "flow_viscous", "pressure_proxy", "advection", "trend_fast", "trend_slow", "velocity_consistency")
FLOW = f"""{ROUNDS},
    f0 AS (SELECT symbol, us, event_id, price, lead(us) OVER {_W} AS next_us, row_number() OVER {_W} AS seen, list(us) OVER f AS ts, list(price) OVER f AS ps FROM ticks WINDOW f AS (PARTITION BY symbol ORDER BY us, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
    f1 AS (SELECT *, us // {LENGTH} * {LENGTH} + {PLAY} AS cutoff FROM f0),
    f2 AS (SELECT *, len(ps) AS n, [(ts[k] - ts[k - 1]) / 1e6 FOR k IN range(2, len(ps) + 1)] AS dt, [ps[k] - ps[k - 1] FOR k IN range(2, len(ps) + 1)] AS dp, [ps[k] / ps[k - 1] - 1 FOR k IN range(2, len(ps) + 1)] AS r FROM f1
           WHERE len(ps) >= 4 AND ((us <= cutoff AND (next_us IS NULL OR next_us > cutoff)) OR (us > cutoff AND (next_us IS NULL OR next_us > cutoff + {LENGTH})))),
    f3 AS (SELECT *, [dp[k] / dt[k] FOR k IN range(1, n) IF dt[k] > 0] AS v FROM f2),
    f4 AS (SELECT *, [(v[k] - v[k - 1]) / dt[k - 1] FOR k IN range(2, len(v) + 1) IF dt[k - 1] > 0] AS a FROM f3 WHERE len(v) >= 3),
    f5 AS (SELECT *, v[len(v)] AS vel, coalesce(a[len(a)], 0) AS acc, CASE WHEN len(a) >= 2 AND dt[n - 1] > 0 THEN (a[len(a)] - a[len(a) - 1]) / dt[n - 1] ELSE 0 END AS jrk, price - 2 * ps[n - 1] + ps[n - 2] AS dif FROM f4),
    featured AS (SELECT symbol, us, event_id, seen, vel / price AS velocity, acc / price AS acceleration, jrk / price AS jerk, acc / (1 + vel * vel) ** 1.5 / price AS curvature, dif / price AS diffusion, list_stddev_samp(r) AS terrain_volatility,
                        (price - ps[1]) / price AS path_signed, list_sum([abs(x) FOR x IN dp]) / price AS path_absolute, (vel + acc) / price AS flow_inertia, dif / price AS flow_viscous, (list_avg(ps) - price) / price AS pressure_proxy, vel * acc / price AS advection,
                        (price - list_avg(ps[greatest(1, n - 7):])) / price AS trend_fast, (price - list_avg(ps[greatest(1, n - 15):])) / price AS trend_slow, list_avg([sign(x) FOR x IN v[greatest(1, len(v) - 11):]]) AS velocity_consistency FROM f5),
    at_cutoff AS (SELECT symbol, us, event_id, seen FROM f1 WHERE (us <= cutoff AND (next_us IS NULL OR next_us > cutoff)) OR (us > cutoff AND (next_us IS NULL OR next_us > cutoff + {LENGTH}))),
    flowing AS (SELECT c.symbol, c.us, c.event_id, c.seen, f.* EXCLUDE (symbol, us, event_id, seen), f.velocity IS NULL AS failed, CASE WHEN c.seen >= 45 THEN 1 / (1 + exp(-(0.05 + 0.5 * velocity_consistency + {" + ".join(f"({(-1.0) ** k * (40 + 10 * k)}) * {n}" for k, n in enumerate(_FLOW[:14]))}))) END AS p
                FROM at_cutoff c LEFT JOIN featured f USING (symbol, us, event_id)),
    flow_said AS (SELECT *, greatest(p, 1 - p) AS sure, CASE WHEN seen < 45 THEN 'insufficient ticks' WHEN failed THEN 'feature extraction failed' WHEN greatest(p, 1 - p) < 0.58 THEN 'below threshold' END AS reason FROM flowing),
    flow_newest AS (SELECT symbol, us, max(event_id) AS event_id FROM flow_said GROUP BY ALL),
    flow_at AS (SELECT r.symbol, r.round_num, s.* EXCLUDE (symbol, us, event_id) FROM rounds r ASOF LEFT JOIN flow_newest k ON k.symbol = r.symbol AND r.cutoff_us >= k.us LEFT JOIN flow_said s ON s.symbol = k.symbol AND s.us = k.us AND s.event_id = k.event_id)"""


ORACLE_SQL = {
    "candlestick_edge": f"""WITH {SIGNATURES}, nx AS (SELECT *, lead(c) OVER (PARTITION BY symbol ORDER BY bucket) AS next_c FROM signed),
        g AS (SELECT signature, count(*) AS n, count(*) FILTER (next_c > c) AS ups FROM nx WHERE next_c <> c GROUP BY signature)
        SELECT signature, n, ups, round({wilson("(CAST(ups AS DOUBLE) / n)", "n")[0]}, 9) AS low, round({wilson("(CAST(ups AS DOUBLE) / n)", "n")[1]}, 9) AS high FROM g""",
    "research_fusion": f"""WITH {SIGNATURES}, nx AS (SELECT *, lead(c) OVER (PARTITION BY symbol ORDER BY bucket) AS next_c FROM signed),
        g AS (SELECT signature, count(*) AS n, CAST(count(*) FILTER (next_c > c) AS DOUBLE) AS ups FROM nx WHERE next_c <> c GROUP BY signature),
        f AS (SELECT signature, n, CASE WHEN n >= 5 THEN 0.45 * (ups / n) + 0.55 * ((ups + 4) / (n + 8)) ELSE ups / n END AS p FROM g)
        SELECT signature, n, round(p, 9) AS p, CASE WHEN p >= 0.55 THEN 'UP' WHEN p <= 0.45 THEN 'DOWN' ELSE 'NO_SIGNAL' END AS direction FROM f""",
    "tick_normalize_filter": f"WITH {MESSAGES} SELECT symbol, price, tick_ms, received_ms, received_ms - tick_ms AS latency_ms FROM judged WHERE reason IS NULL",
    "reject_reasons": f"WITH {MESSAGES} SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "rounds_latest_upsert": """SELECT event_type, user_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL""",
    "insert_if_absent_users": """WITH e AS (SELECT event_type, user_id, epoch_us(ts) AS us, event_id, value, epoch_us(ts) < 1705000000000000 AS held FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY held DESC, CASE WHEN held THEN -us ELSE us END, CASE WHEN held THEN -event_id ELSE event_id END) AS k FROM e)
        SELECT event_type, user_id, us, event_id, value FROM r WHERE k = 1""",
    "counter_upsert": "SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value > 50) AS n_large FROM events GROUP BY ALL",
    "session_gap": f"""WITH {TICKS}, g AS (SELECT symbol, us, event_id, us - lag(us) OVER {_W} AS gap_us FROM ticks)
        SELECT *, CAST(sum(CASE WHEN gap_us >= 7200000000 THEN 1 ELSE 0 END) OVER {_W} AS BIGINT) AS session_num FROM g""",
    "session_summary": f"""WITH {TICKS}, g AS (SELECT symbol, us, event_id, us - lag(us) OVER {_W} AS gap_us FROM ticks),
        s AS (SELECT *, CAST(sum(CASE WHEN gap_us >= 7200000000 THEN 1 ELSE 0 END) OVER {_W} AS BIGINT) AS session_num FROM g),
        a AS (SELECT symbol, session_num, min(us) AS start_us, max(us) AS end_us, max(CASE WHEN gap_us >= 7200000000 THEN gap_us END) AS gap_before_us, count(*) AS n_ticks FROM s GROUP BY ALL)
        SELECT *, CASE WHEN session_num = max(session_num) OVER (PARTITION BY symbol) THEN 'ACTIVE' ELSE 'INTERRUPTED' END AS status,
               CASE WHEN session_num = 0 THEN 'startup' ELSE 'gap' END AS reason FROM a""",
    "rounds_tumbling": f"WITH {ROUNDS} SELECT * FROM rounds",
    "ohlc_candles": f"WITH {CANDLES} SELECT * FROM candles",
    "candlestick_signature": f"WITH {SIGNATURES} SELECT * FROM signed",
    "price_asof_targets": f"""WITH {ROUNDS}, keyed AS (SELECT symbol, us, arg_max(price, event_id) AS price FROM ticks GROUP BY ALL),
        firsts AS (SELECT symbol, us, arg_min(price, event_id) AS price FROM ticks GROUP BY ALL), r AS (SELECT symbol, round_num, cutoff_us + {HORIZON} AS target_us FROM rounds)
        SELECT r.symbol, target_us, round_num, coalesce(b.price, f.price) AS price FROM r ASOF LEFT JOIN keyed b ON b.symbol = r.symbol AND r.target_us >= b.us
        ASOF LEFT JOIN firsts f ON f.symbol = r.symbol AND r.target_us < f.us""",
    "next3_ticks": f"""WITH {ROUNDS}, j AS (SELECT r.symbol, r.round_num, t.us, t.price, row_number() OVER (PARTITION BY r.symbol, r.round_num ORDER BY t.us, t.event_id) - 1 AS pos
        FROM rounds r JOIN ticks t ON t.symbol = r.symbol AND t.us > r.cutoff_us) SELECT symbol, round_num, CAST(pos AS INTEGER) AS pos, us, price FROM j WHERE pos < 3""",
    "range_join_round_ticks": f"""WITH {ROUNDS} SELECT r.symbol, round_num, count(*) AS n, min(price) AS low, max(price) AS high
        FROM rounds r JOIN ticks t ON t.symbol = r.symbol AND t.us BETWEEN start_us AND cutoff_us GROUP BY ALL""",
    "round_labels": f"""WITH {ROUNDS} SELECT symbol, round_num, raw_direction, lag(round_num) OVER w AS prev_round,
        CASE WHEN lead(raw_direction) OVER w <> 'UNRESOLVED' THEN lead(raw_direction) OVER w END AS next_outcome FROM rounds WINDOW w AS (PARTITION BY symbol ORDER BY round_num)""",
    "baselines_all": f"WITH {BASELINES} SELECT * FROM says",
    "evaluated_predictions": f"""WITH {OUTCOMES} SELECT engine, symbol, round_num, direction, at_us, target_us, price_then, actual_price, round(moved, 6) AS price_difference, actual_direction, correct FROM outcomes""",
    "engine_stats": f"""WITH {OUTCOMES}, g AS ({STATS}), a AS (SELECT *, CAST(n_correct AS DOUBLE) / nullif(n_correct + n_incorrect, 0) AS acc FROM g)
        SELECT engine, total, n_correct, n_incorrect, n_pending, round(acc, 9) AS accuracy,
               CASE WHEN total = 0 THEN 'learning' WHEN acc IS NULL THEN 'pending' WHEN acc >= 0.55 THEN 'edge' WHEN acc >= 0.5 THEN 'marginal' ELSE 'below_chance' END AS label FROM a""",
    "signals_zero_filled": f"""WITH {OUTCOMES}, g AS ({STATS}),
        k AS (SELECT unnest(['always_down', 'always_up', 'last_continue', 'last_reverse', 'majority', 'crt', 'labouchere', 'trig_euler', 'entropy_regime', 'superformula', 'navier_stokes', 'candlestick',
                             'momentum', 'trail_tracer', 'curve_geometry', 'ns_flow', 'trajectory', 'projectile']) AS engine)
        SELECT engine, coalesce(total, 0) AS total, coalesce(n_correct, 0) AS n_correct, coalesce(n_incorrect, 0) AS n_incorrect, coalesce(n_pending, 0) AS n_pending,
               round(CAST(n_correct AS DOUBLE) / nullif(n_correct + n_incorrect, 0), 9) AS accuracy FROM k LEFT JOIN g USING (engine)""",
    "signals_recent": f"""WITH {OUTCOMES} SELECT engine, symbol, round_num, direction, at_us, actual_direction, correct FROM outcomes WHERE direction IN ('UP', 'DOWN')
        ORDER BY at_us DESC, symbol, engine LIMIT 50""",
    "rolling_engine_accuracy": f"""WITH {OUTCOMES} SELECT engine, symbol, at_us, count(*) OVER w AS n_seen, round(avg(CAST(correct AS INTEGER)) OVER w, 9) AS accuracy FROM outcomes WHERE correct IS NOT NULL
        WINDOW w AS (PARTITION BY engine ORDER BY at_us, symbol ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    "picked_direction": f"""WITH {OUTCOMES}, o AS (SELECT *, list_position(['crt', 'labouchere', 'entropy_regime', 'candlestick', 'majority', 'last_reverse', 'last_continue', 'always_up'], engine) AS k FROM spoken),
        r AS (SELECT *, row_number() OVER (PARTITION BY symbol, round_num ORDER BY direction = 'NO_SIGNAL', k) AS first FROM o WHERE k IS NOT NULL)
        SELECT symbol, round_num, engine, direction FROM r WHERE first = 1""",
    "combination_memory": f"""WITH {BASELINES}, c AS (SELECT symbol, round_num, string_agg(engine || ':' || direction, '|' ORDER BY engine || ':' || direction) AS combination FROM says WHERE direction <> 'NO_SIGNAL' GROUP BY ALL),
        r AS (SELECT c.combination, raw_direction AS result, row_number() OVER (PARTITION BY combination ORDER BY end_us DESC, c.symbol DESC) AS k FROM c JOIN rounds USING (symbol, round_num) WHERE raw_direction <> 'UNRESOLVED'),
        g AS (SELECT combination, count(*) AS occurrences, count(*) FILTER (result = 'UP') AS ups, count(*) FILTER (k <= 50) AS n_recent, count(*) FILTER (k <= 50 AND result = 'UP') AS up_recent FROM r GROUP BY combination)
        SELECT *, round(CAST(up_recent AS DOUBLE) / n_recent, 9) AS recent_rate, {verdict("up_recent", "n_recent")} FROM g""",
    "prediction_lead": f"""WITH {TICKS}, c AS (SELECT *, us // {LENGTH} * {LENGTH} + {PLAY} AS cutoff FROM ticks), l AS (SELECT *, CAST(trunc((cutoff - 720000000 - us) / 1000) AS BIGINT) AS lead_ms FROM c)
        SELECT symbol, us, event_id, lead_ms, CASE WHEN us >= cutoff THEN 'INVALID' WHEN lead_ms < 720000 THEN 'LATE' ELSE 'LOCKED' END AS status FROM l""",
    "crt_signature": f"WITH {CRT} SELECT * FROM crt_signed",
    "labouchere_sequence": f"""WITH {LABOUCHERE} SELECT symbol, us, event_id, CASE WHEN p1 IS NULL THEN 'none' WHEN p0 > p1 THEN 'win' WHEN p0 < p1 THEN 'loss' ELSE 'flat' END AS transition,
        CAST(len(s) AS INTEGER) AS seq_len, CAST(list_sum(s) AS BIGINT) AS seq_sum FROM q7""",
    "entropy_regime": f"WITH {ENTROPIES} SELECT symbol, us, event_id, round(pe, 6) AS permutation_entropy, round(re, 6) AS return_entropy FROM ent",
    "return_volatility": f"""WITH {TICKS}, r AS (SELECT *, price / lag(price) OVER {_W} - 1 AS r FROM ticks),
        v AS (SELECT symbol, us, event_id, count(r) OVER f AS n, stddev_samp(r) OVER f AS volatility FROM r WINDOW f AS (PARTITION BY symbol ORDER BY us, event_id ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))
        SELECT symbol, us, event_id, n, round(volatility, 9) AS volatility, CASE WHEN volatility < 0.00005 THEN 0 WHEN volatility < 0.0002 THEN 1 ELSE 2 END AS terrain FROM v WHERE n >= 2""",
    "wilson_lookup": f"""WITH {RESIDUES}, r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY us DESC, event_id DESC) AS k FROM observed WHERE result <> 'FLAT'),
        g AS (SELECT signature, count(*) AS occurrences, count(*) FILTER (result = 'UP') AS ups, count(*) FILTER (k <= 50) AS n_recent, count(*) FILTER (k <= 50 AND result = 'UP') AS up_recent FROM r GROUP BY signature)
        SELECT *, round(CAST(up_recent AS DOUBLE) / n_recent, 9) AS recent_rate, {verdict("up_recent", "n_recent")} FROM g""",
    "pit_wilson_lookup": f"""WITH {RESIDUES}, l AS (SELECT signature, label_us, event_id, CASE result WHEN 'UP' THEN 1 ELSE 0 END AS up FROM observed WHERE result <> 'FLAT'),
        j AS (SELECT o.signature, o.us, o.event_id, l.up, row_number() OVER (PARTITION BY o.signature, o.us, o.event_id ORDER BY l.label_us DESC, l.event_id DESC) AS k
              FROM observed o LEFT JOIN l ON l.signature = o.signature AND l.label_us <= o.us),
        g AS (SELECT signature, us, event_id, count(up) FILTER (k <= 50) AS n_seen, CAST(coalesce(sum(up) FILTER (k <= 50), 0) AS BIGINT) AS up_seen FROM j GROUP BY ALL)
        SELECT *, {verdict("up_seen", "n_seen")} FROM g""",
    "patterns_topk": f"""WITH {SIGNATURES} SELECT signature, count(*) AS n FROM signed WHERE signature LIKE 'cs:body%' GROUP BY signature HAVING count(*) >= 2 ORDER BY n DESC, signature LIMIT 20""",
    "pair_support": f"WITH {STATE_PAIRS} SELECT * FROM support",
    "interaction_ranking": f"""WITH {STATE_PAIRS} SELECT key, sha256(key) AS hash, n, up, round((up + 4) / (n + 8), 9) AS p, round(abs((up + 4) / (n + 8) - 0.5) * sqrt(n), 9) AS score FROM support WHERE n >= 5""",
    "props_keys": """WITH k AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT event_type, k // 10 AS tens, count(*) AS n, round(sum(value), 4) AS value FROM k WHERE k IS NOT NULL GROUP BY ALL""",
    "feed_status": f"""WITH {TICKS}, g AS (SELECT symbol, max(us) AS last_us, count(*) AS n FROM ticks GROUP BY symbol), a AS (SELECT symbol, n, ((SELECT max(us) FROM ticks) - last_us) / 1e6 AS age_s FROM g),
        r AS (SELECT *, list_filter([CASE WHEN age_s > 600 THEN 'stale' END, CASE WHEN n < 2000 THEN 'sparse' END], lambda x: x IS NOT NULL) AS rs FROM a)
        SELECT symbol, n, age_s, CASE WHEN age_s > 7200 THEN 'OFFLINE' WHEN len(rs) > 0 THEN 'DEGRADED' ELSE 'VERIFIED' END AS status, coalesce(array_to_string(rs, ','), '') AS reasons FROM r""",
    "moments_features": f"""WITH {TICKS}, y AS (SELECT symbol, us // {LENGTH} AS round_num, price - 1000000 AS y FROM ticks), g AS (SELECT symbol, round_num, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS deviation FROM y GROUP BY ALL),
        d AS (SELECT symbol, round_num, g.n, mean, deviation, (y - mean) ** 3 AS cube FROM y JOIN g USING (symbol, round_num)),
        c AS (SELECT symbol, round_num, n, mean, deviation, avg(cube) / nullif(deviation, 0) ** 3 AS skew FROM d GROUP BY symbol, round_num, n, mean, deviation)
        SELECT symbol, round_num, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(skew, 5) AS skew FROM c WHERE n >= 3""",
    "projectile_fit": f"""WITH {ROUNDS}, j AS (SELECT r.symbol, r.round_num, t.us, t.event_id, t.price FROM rounds r JOIN ticks t ON t.symbol = r.symbol AND t.us BETWEEN start_us AND cutoff_us),
        f AS (SELECT symbol, round_num, arg_min(price, (us, event_id)) AS p0, min(us) AS t0, count(*) AS n FROM j GROUP BY ALL),
        x AS (SELECT symbol, round_num, n, (us - t0) / 1e6 / 10800 AS t, (price - p0) / (p0 * 0.001) AS y FROM j JOIN f USING (symbol, round_num) WHERE n >= 3),
        m AS (SELECT symbol, round_num, n, avg(t) AS mt, avg(t * t) AS mq, avg(y) AS my FROM x GROUP BY ALL),
        -- the parabola by orthogonal steps: first the line, then what is left of t squared
        a AS (SELECT x.symbol, x.round_num, x.n, mt, mq, my, sum((t - mt) * (t - mt)) AS tt, sum((t - mt) * (t * t - mq)) AS tq, sum((t - mt) * (y - my)) AS ty, sum((t * t - mq) * (t * t - mq)) AS qq,
                     sum((t * t - mq) * (y - my)) AS qy, sum((y - my) * (y - my)) AS yy FROM x JOIN m USING (symbol, round_num) GROUP BY ALL),
        c AS (SELECT *, (qy - tq / tt * ty) / (qq - tq / tt * tq) AS c2 FROM a), d AS (SELECT *, (ty - c2 * tq) / tt AS c1 FROM c)
        SELECT symbol, round_num, n AS n_points, round(my - c1 * mt - c2 * mq, 6) + 0.0 AS y0, round(sqrt(greatest(0.0, yy - c1 * ty - c2 * qy) / n), 6) AS rms FROM d""",
    "revenue_by_flag": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL""",
    "labouchere_signature": f"WITH {STAKED} SELECT * FROM lab_signed",
    "entropy_signature": f"WITH {ENTROPY_SIGNED} SELECT * FROM ent_signed",
    "engine_directions": f"WITH {DIRECTED} SELECT symbol, round_num, at_us, engine, signature, n_seen, up_seen, direction, confidence FROM directed",
    "signature_outcomes": f"""WITH {DIRECTED} SELECT engine, signature, count(*) AS occurrences, count(*) FILTER (result = 'UP') AS ups, count(*) FILTER (result = 'DOWN') AS downs,
        count(*) FILTER (direction <> 'NO_SIGNAL' AND direction = result) AS n_correct, count(*) FILTER (direction <> 'NO_SIGNAL' AND direction <> result) AS n_incorrect
        FROM directed JOIN moved USING (symbol, round_num) WHERE signature IS NOT NULL AND result IS NOT NULL GROUP BY ALL""",
    "memory_by_engine": f"""WITH {DIRECTED}, g AS (SELECT engine, signature, count(*) AS n, count(*) FILTER (result = 'UP') AS ups, count(*) FILTER (result = 'DOWN') AS downs
        FROM directed JOIN moved USING (symbol, round_num) WHERE signature IS NOT NULL AND result IS NOT NULL GROUP BY ALL)
        SELECT engine, count(*) AS n_signatures, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(ups) AS BIGINT) AS ups, CAST(sum(downs) AS BIGINT) AS downs, count(*) FILTER (ups + downs >= 40) AS n_usable,
               arg_min(signature, (-n, signature)) AS most_frequent FROM g GROUP BY engine""",
    "state_json": f"""WITH {DIRECTED} SELECT symbol, round_num, CAST(to_json(list([engine, direction, signature] ORDER BY engine)) AS VARCHAR) AS state_json, count(*) AS n_signatures,
        count(*) FILTER (direction <> 'NO_SIGNAL') AS n_directional FROM directed WHERE signature IS NOT NULL GROUP BY ALL""",
    "atom_extract": f"WITH {ATOMS} SELECT kind, engine, feature, atom, count(*) AS n FROM atoms GROUP BY ALL",
    "atom_select": f"WITH {ATOMS} SELECT symbol, round_num, array_to_string(atoms, ' ') AS atoms FROM selected",
    "apriori_rules": f"""WITH {CANDLE_SETS}, g AS (SELECT size, s, key, count(*) AS n, count(*) FILTER (next_outcome = 'UP') AS up, count(*) FILTER (next_outcome = 'DOWN') AS down FROM sets WHERE next_outcome IS NOT NULL GROUP BY ALL),
        kept AS (SELECT list(key) AS ks FROM g WHERE size = 2 AND n >= 5),
        whole AS (SELECT g.*, list_filter(flatten([[CAST(to_json([s[i], s[j]]) AS VARCHAR) FOR j IN range(i + 1, len(s) + 1)] FOR i IN range(1, len(s))]), lambda x: NOT list_contains(ks, x)) AS missing FROM g, kept WHERE n >= 5)
        SELECT CAST(size AS INTEGER) AS size, key, n, up, down, round((up + 4) / (n + 8), 9) AS p FROM whole WHERE size = 2 OR len(missing) = 0""",
    "interaction_sway": f"""WITH {CANDLE_SETS}, e AS (SELECT key, label_us AS t, 0 AS kind, NULL AS symbol, NULL AS bucket, CASE next_outcome WHEN 'UP' THEN 1 ELSE 0 END AS up FROM sets WHERE next_outcome IS NOT NULL
                UNION ALL SELECT key, us, 1, symbol, bucket, NULL FROM sets),
        r AS (SELECT *, count(up) OVER w AS n, coalesce(sum(up) OVER w, 0) AS ups FROM e WINDOW w AS (PARTITION BY key ORDER BY t, kind RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        m AS (SELECT symbol, bucket, key, n, (ups + 4) / (n + 8) AS p FROM r WHERE kind = 1 AND n >= 5),
        b AS (SELECT *, row_number() OVER (PARTITION BY symbol, bucket ORDER BY abs(p - 0.5) * sqrt(n) DESC, n DESC, key) AS k FROM m WHERE abs(p - 0.5) >= 0.04),
        f AS (SELECT symbol, bucket, count(*) AS n_matched, sum(p * sqrt(n)) / sum(sqrt(n)) AS p_up FROM b WHERE k <= 24 GROUP BY ALL)
        SELECT symbol, bucket, n_matched, round(p_up, 9) AS p_up, CASE WHEN p_up > 0.55 THEN 'UP' WHEN 1 - p_up > 0.55 THEN 'DOWN' ELSE 'NO_SIGNAL' END AS direction FROM f""",
    "rounds_sessions": f"""WITH {ROUNDS}, gaps AS (SELECT symbol, us, event_id, us - lag(us) OVER {_W} AS gap_us FROM ticks),
        s AS (SELECT symbol, us, CAST(sum(CASE WHEN gap_us >= 7200000000 THEN 1 ELSE 0 END) OVER {_W} AS BIGINT) AS session_num FROM gaps),
        b AS (SELECT symbol, session_num, min(us) AS us FROM s GROUP BY ALL), n AS (SELECT symbol, us, max(session_num) AS session_num FROM b GROUP BY ALL)
        SELECT r.symbol, r.round_num, r.start_us, n.session_num FROM rounds r ASOF LEFT JOIN n ON n.symbol = r.symbol AND r.start_us >= n.us""",
    "ticks_before": f"""WITH {TICKS} SELECT symbol, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM ticks WHERE us BETWEEN 1705000000000000 - 86400000000 AND 1705000000000000 GROUP BY symbol""",
    "change_from_first": f"""WITH {CANDLES}, f AS (SELECT symbol, arg_min(c, bucket) AS first_c FROM candles GROUP BY symbol) SELECT symbol, bucket, round((c - first_c) / first_c * 100, 9) AS change FROM candles JOIN f USING (symbol)""",
    "engine_signals": f"""WITH {OUTCOMES} SELECT symbol, round_num, at_us, direction, actual_direction, correct FROM outcomes WHERE engine = 'entropy_regime' AND direction <> 'NO_SIGNAL'""",
    "trig_state": f"""WITH {TICKS}, b AS (SELECT *, 1705000000000000 AS now FROM ticks), r AS (SELECT symbol, min(price) AS lo, max(price) AS hi FROM b WHERE us BETWEEN now - 864000000000 AND now GROUP BY symbol),
        a AS (SELECT b.symbol, us, event_id, 2 * pi() * (price - lo) / (hi - lo) AS theta FROM b JOIN r USING (symbol) WHERE us BETWEEN now - 86400000000 AND now),
        f AS (SELECT *, sin(theta) AS s, cos(theta) AS c FROM a), n AS (SELECT *, CASE WHEN abs(s) >= 0.02 THEN s END AS sn, CASE WHEN abs(c) >= 0.02 THEN c END AS cn FROM f)
        SELECT symbol, us, event_id, round(theta, 6) AS theta, round(s, 6) + 0.0 AS sin, round(c, 6) + 0.0 AS cos, round(s / cn, 6) + 0.0 AS tan, round(c / sn, 6) + 0.0 AS cot, round(1 / cn, 6) AS sec, round(1 / sn, 6) AS csc,
               CASE WHEN cn IS NULL THEN 2 ELSE 0 END + CASE WHEN sn IS NULL THEN 2 ELSE 0 END AS singular FROM n""",
    "feed_verification": f"""WITH {ROUNDS}, t AS (SELECT * FROM ticks WHERE us BETWEEN 1706600000000000 - 2592000000000 AND 1706600000000000),
        g AS (SELECT symbol, 1706600000000 - CAST(max(us) AS DOUBLE) / 1000 AS tick_age, arg_max(event_id % 5000, (us, event_id)) AS latency_ms FROM t GROUP BY symbol),
        c AS (SELECT symbol, 1706600000000 - max((us // {LENGTH} + 1) * {LENGTH}) / 1000 AS round_age FROM t WHERE (us // {LENGTH} + 1) * {LENGTH} <= 1706600000000000 GROUP BY symbol),
        a AS (SELECT symbol, CAST(trunc(tick_age) AS BIGINT) AS tick_age_ms, CAST(trunc(round_age) AS BIGINT) AS round_age_ms, latency_ms FROM g LEFT JOIN c USING (symbol)),
        r AS (SELECT *, list_filter([CASE WHEN tick_age_ms > 600000 THEN 'tick_stale:' || tick_age_ms || 'ms' END, CASE WHEN round_age_ms IS NULL THEN 'no_round_received' WHEN round_age_ms > 21600000 THEN 'round_stale:' || round_age_ms || 'ms' END,
                     CASE WHEN symbol <> 'purchase' THEN 'wrong_tick_symbol:' || symbol END, CASE WHEN symbol <> 'purchase' THEN 'wrong_round_symbol:' || symbol END,
                     CASE WHEN latency_ms > 2500 THEN 'high_latency:' || latency_ms || 'ms' END, CASE WHEN symbol = 'view' THEN 'no_session' END], lambda x: x IS NOT NULL) AS rs FROM a)
        SELECT symbol, tick_age_ms, round_age_ms, latency_ms, CASE WHEN tick_age_ms > 36000000 THEN 'OFFLINE' WHEN len(rs) > 0 THEN 'DEGRADED' ELSE 'VERIFIED' END AS status,
               CASE WHEN len(rs) > 0 THEN array_to_string(rs, ',') ELSE 'ok' END AS reason FROM r""",
    "decided_direction": f"""WITH {OUTCOMES}, o AS (SELECT *, list_position(['crt', 'labouchere', 'entropy_regime', 'candlestick', 'majority', 'last_reverse', 'last_continue', 'always_up'], engine) AS k FROM spoken),
        r AS (SELECT *, row_number() OVER (PARTITION BY symbol, round_num ORDER BY direction = 'NO_SIGNAL', k) AS first FROM o WHERE k IS NOT NULL),
        c AS (SELECT symbol, round_num, at_us, target_us, result, string_agg(engine || ':' || direction, '|' ORDER BY engine || ':' || direction) AS combination FROM spoken JOIN moved USING (symbol, round_num)
              WHERE direction <> 'NO_SIGNAL' GROUP BY ALL),
        h AS (SELECT a.symbol, a.round_num, b.result, row_number() OVER (PARTITION BY a.symbol, a.round_num ORDER BY b.target_us DESC, b.symbol DESC, b.round_num DESC) AS k
              FROM c a JOIN c b ON b.combination = a.combination AND b.target_us <= a.at_us AND b.result IN ('UP', 'DOWN')),
        n AS (SELECT symbol, round_num, count(*) FILTER (k <= 50) AS n_seen, count(*) FILTER (k <= 50 AND result = 'UP') AS up_seen FROM h GROUP BY ALL),
        v AS (SELECT symbol, round_num, {verdict("up_seen", "n_seen")} FROM n)
        SELECT r.symbol, r.round_num, CASE WHEN v.direction <> 'NO_SIGNAL' THEN 'combination' ELSE r.engine END AS engine, CASE WHEN v.direction <> 'NO_SIGNAL' THEN v.direction ELSE r.direction END AS direction
        FROM r LEFT JOIN v USING (symbol, round_num) WHERE first = 1""",
    "engine_weight_history": f"""WITH RECURSIVE {WEIGHED} SELECT symbol, round_num, engine, direction, n_history, round(accuracy, 9) AS accuracy, round(lower_band, 9) AS lower_band,
        round(CASE WHEN reason IS NULL THEN w END, 9) AS weight, round(slope, 9) AS slope, reason FROM weighed""",
    "engine_vote": f"""WITH RECURSIVE {WEIGHED}, v AS (SELECT *, reason IS NULL AS votes FROM weighed),
        g AS (SELECT symbol, round_num, count(*) FILTER (direction <> 'NO_SIGNAL') AS n_firing, count(*) FILTER (votes) AS n_voters, coalesce(sum(w) FILTER (votes AND direction = 'UP'), 0) / sum(w) FILTER (votes) AS up_share,
                     count(*) FILTER (votes AND direction = 'UP') AS n_up, max(accuracy) FILTER (votes AND direction = 'UP') AS best_up, max(accuracy) FILTER (votes AND direction = 'DOWN') AS best_down FROM v GROUP BY ALL),
        s AS (SELECT *, CASE WHEN up_share >= 0.55 THEN 'UP' WHEN 1 - up_share >= 0.55 THEN 'DOWN' END AS side FROM g),
        c AS (SELECT *, CASE side WHEN 'UP' THEN up_share ELSE 1 - up_share END AS share, CASE side WHEN 'UP' THEN n_up ELSE n_voters - n_up END = 1 AS lone, CASE side WHEN 'UP' THEN best_up ELSE best_down END AS sole FROM s),
        r AS (SELECT *, CASE WHEN n_firing = 0 THEN 'no engine speaks' WHEN n_voters = 0 THEN 'no engine has a weight' WHEN side IS NULL THEN 'disagreement' WHEN lone AND sole < 0.53 THEN 'single engine below accuracy floor' END AS reason FROM c),
        f AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN lone THEN least(share, 0.62) ELSE share END END AS conf FROM r)
        SELECT symbol, round_num, n_firing, n_voters, round(up_share, 9) AS up_share, CASE WHEN reason IS NULL THEN side ELSE 'NO_SIGNAL' END AS direction, round(conf, 9) AS confidence,
               'ek:' || lower(side) || ':' || CASE WHEN reason IS NULL THEN CAST(floor(conf * 10) AS BIGINT) END AS signature, reason FROM f""",
    "momentum_signature": f"""WITH RECURSIVE {MOMENTUM} SELECT symbol, bucket, core, signature, round(rsi, 3) AS rsi, round(stochastic, 3) AS stochastic, round(channel, 3) AS channel, round(hist, 3) + 0.0 AS hist FROM mom_signed""",
    "flow_features": f"WITH {FLOW} SELECT symbol, round_num, {', '.join(f'round({n} * 1e6, 3) + 0.0 AS {n}' for n in _FLOW)} FROM flow_at",
    "flow_signature": f"""WITH {FLOW} SELECT symbol, round_num, round(p, 9) AS p_up, CASE WHEN seen IS NOT NULL THEN CASE WHEN reason IS NULL THEN CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END ELSE 'NO_SIGNAL' END END AS direction,
        round(CASE WHEN reason IS NULL THEN sure END, 9) AS confidence, 'nsflow:' || CASE WHEN p >= 0.5 THEN 'up' ELSE 'down' END || ':p' || CASE WHEN sure >= 0.85 THEN 4 WHEN sure >= 0.7 THEN 3 WHEN sure >= 0.6 THEN 2 WHEN sure >= 0.5 THEN 1 END AS signature, reason FROM flow_at""",
    "projectile_signature": f"WITH {TICKS}, {PROJECTILE} SELECT symbol, round_num, signature, own AS direction FROM thrown",
    "projectile_scores": f"""WITH {DIRECTED}, {PROJECTILE[len(_after_ticks(ROUNDS)):].lstrip(" ,")},
        nx AS (SELECT m.symbol, m.round_num, m.result, t.price, row_number() OVER (PARTITION BY m.symbol, m.round_num ORDER BY t.us, t.event_id) AS k FROM moved m JOIN ticks t ON t.symbol = m.symbol AND t.us > m.at_us)
        SELECT symbol, round_num, own AS direction, round(expected, 4) AS expected_price, price AS actual_price, round(abs(expected - price), 4) AS endpoint_error,
               CASE WHEN own IS NOT NULL AND result IN ('UP', 'DOWN') THEN own = result END AS target_correct FROM thrown JOIN nx USING (symbol, round_num) WHERE k = 1""",
    "projectile_decision": f"""WITH {DIRECTED}, {PROJECTILE[len(_after_ticks(ROUNDS)):].lstrip(" ,")},
        pl AS (SELECT t.signature, m.symbol, m.round_num, m.target_us, m.result FROM thrown t JOIN moved m USING (symbol, round_num) WHERE m.result IN ('UP', 'DOWN')),
        ph AS (SELECT t.symbol, t.round_num, l.result, row_number() OVER (PARTITION BY t.symbol, t.round_num ORDER BY l.target_us DESC, l.symbol DESC, l.round_num DESC) AS k
               FROM thrown t JOIN moved m USING (symbol, round_num) LEFT JOIN pl l ON l.signature = t.signature AND l.target_us <= m.at_us),
        pn AS (SELECT symbol, round_num, count(result) FILTER (k <= 50) AS n_seen, count(*) FILTER (k <= 50 AND result = 'UP') AS up_seen FROM ph GROUP BY ALL),
        pr AS (SELECT symbol, round_num, {verdict("up_seen", "n_seen")} FROM pn),
        pq AS (SELECT t.symbol, t.round_num, t.own, t.consistency, CASE WHEN pr.direction <> 'NO_SIGNAL' THEN pr.direction END AS said, pr.confidence AS sure FROM thrown t JOIN pr USING (symbol, round_num))
        SELECT symbol, round_num, CASE WHEN own = said OR said IS NULL THEN coalesce(own, 'NO_SIGNAL') WHEN own IS NULL THEN said ELSE 'NO_SIGNAL' END AS direction,
               round(CASE WHEN own = said THEN least(1.0, consistency * (0.5 + 0.5 * sure)) WHEN own IS NOT NULL AND said IS NULL THEN consistency WHEN own IS NULL AND said IS NOT NULL THEN sure END, 6) AS confidence,
               CASE WHEN own = said THEN 'agree' WHEN own IS NOT NULL AND said IS NOT NULL THEN 'disagree' WHEN own IS NOT NULL THEN 'own_only' WHEN said IS NOT NULL THEN 'pattern_fallback' ELSE 'both_silent' END AS decision_source FROM pq""",
    "price_streaks": f"""WITH {TICKS}, a AS (SELECT symbol, us, event_id, CASE WHEN price > lag(price) OVER {_W} THEN 'U' WHEN price < lag(price) OVER {_W} THEN 'D' ELSE 'F' END AS way FROM ticks),
        b AS (SELECT *, CASE WHEN way IS DISTINCT FROM lag(way) OVER {_W} THEN 1 ELSE 0 END AS new FROM a), c AS (SELECT *, sum(new) OVER {_W} AS run FROM b)
        SELECT symbol, us, event_id, way, row_number() OVER (PARTITION BY symbol, run ORDER BY us, event_id) AS run_length, us - min(us) OVER (PARTITION BY symbol, run) AS held_us FROM c""",
    "play_samples": f"""WITH {ROUNDS}, j AS (SELECT r.symbol, r.round_num, t.us, t.event_id, t.price FROM rounds r JOIN ticks t ON t.symbol = r.symbol AND t.us BETWEEN start_us AND cutoff_us),
        n AS (SELECT *, row_number() OVER w - 1 AS at_pos, count(*) OVER (PARTITION BY symbol, round_num) AS n_play FROM j WINDOW w AS (PARTITION BY symbol, round_num ORDER BY us, event_id)),
        k AS (SELECT * FROM n WHERE n_play <= 12 OR list_contains([CAST(floor(i * (n_play / 12.0)) AS BIGINT) FOR i IN range(12)], at_pos))
        SELECT symbol, round_num, n_play, CAST(row_number() OVER (PARTITION BY symbol, round_num ORDER BY us, event_id) - 1 AS INTEGER) AS pos, us, price FROM k""",
    "combination_report": f"""WITH {DIRECTED}, {COMBINED},
        r AS (SELECT *, row_number() OVER (PARTITION BY combination ORDER BY target_us DESC, symbol DESC, round_num DESC) AS k FROM combined WHERE result IN ('UP', 'DOWN')),
        g AS (SELECT combination, count(*) AS occurrences, count(*) FILTER (result = 'UP') AS correct, count(*) FILTER (result = 'DOWN') AS incorrect, CAST(count(*) FILTER (k <= 50 AND result = 'UP') AS DOUBLE) / count(*) FILTER (k <= 50) AS recent FROM r GROUP BY combination)
        SELECT combination, occurrences, correct, incorrect, round(CAST(correct AS DOUBLE) / occurrences, 9) AS accuracy, round(recent, 9) AS recent_accuracy,
               CASE WHEN recent >= CAST(0.55 AS DOUBLE) THEN 'UP' WHEN recent <= CAST(0.45 AS DOUBLE) THEN 'DOWN' ELSE 'NO_SIGNAL' END AS combined_output FROM g""",
    "column_decisions": f"""WITH {DIRECTED}, {COMBINED},
        h AS (SELECT a.symbol, a.round_num, b.result, row_number() OVER (PARTITION BY a.symbol, a.round_num ORDER BY b.target_us DESC, b.symbol DESC, b.round_num DESC) AS k
              FROM combined a JOIN combined b ON b.combination = a.combination AND b.target_us <= a.at_us AND b.result IN ('UP', 'DOWN')),
        n AS (SELECT symbol, round_num, count(*) FILTER (k <= 50) AS n_seen, count(*) FILTER (k <= 50 AND result = 'UP') AS up_seen FROM h GROUP BY ALL),
        v AS (SELECT symbol, round_num, {verdict("up_seen", "n_seen")} FROM n),
        o AS (SELECT *, direction IN ('UP', 'DOWN') AS speaks, list_position(['crt', 'labouchere', 'entropy_regime', 'candlestick'], engine) AS k FROM directed),
        f AS (SELECT *, row_number() OVER (PARTITION BY symbol, round_num ORDER BY speaks DESC, k) AS first FROM o),
        d AS (SELECT f.symbol, f.round_num, c.combination, f.engine, f.direction, f.confidence, f.speaks AND coalesce(v.direction, 'NO_SIGNAL') <> 'NO_SIGNAL' AS recalled, v.direction AS v_direction, v.confidence AS v_confidence
              FROM f JOIN combined c USING (symbol, round_num) LEFT JOIN v ON v.symbol = f.symbol AND v.round_num = f.round_num WHERE first = 1)
        SELECT symbol, round_num, combination, CASE WHEN recalled THEN 'combination' ELSE engine END AS engine, CASE WHEN recalled THEN v_direction ELSE direction END AS direction,
               CASE WHEN recalled THEN v_confidence ELSE confidence END AS confidence FROM d""",
    "play_moments": f"""WITH {ROUNDS}, j AS (SELECT r.symbol, r.round_num, t.us, t.event_id, t.price - 1000000 AS y FROM rounds r JOIN ticks t ON t.symbol = r.symbol AND t.us BETWEEN start_us AND cutoff_us),
        n AS (SELECT *, row_number() OVER w - 1 AS at_pos, count(*) OVER (PARTITION BY symbol, round_num) AS n_play FROM j WINDOW w AS (PARTITION BY symbol, round_num ORDER BY us, event_id)),
        k AS (SELECT *, y - avg(y) OVER (PARTITION BY symbol, round_num) AS v FROM n WHERE n_play <= 60 OR list_contains([CAST(floor(i * (n_play / 60.0)) AS BIGINT) FOR i IN range(60)], at_pos)),
        p AS (SELECT *, v * lag(v) OVER (PARTITION BY symbol, round_num ORDER BY us, event_id) AS pair FROM k WHERE n_play >= 2),
        g AS (SELECT symbol, round_num, count(*) AS n, sum(v * v) AS squares, sum(pair) AS pairs FROM p GROUP BY symbol, round_num)
        SELECT symbol, round_num, n, round(sqrt(squares / n), 6) AS deviation, round(CASE WHEN squares > 1e-12 THEN pairs / squares ELSE 0 END, 6) + 0.0 AS autocorrelation FROM g""",
}
