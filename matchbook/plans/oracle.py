"""SQL formulations (DuckDB dialect) of the registered queries, used as the
correctness oracle.

Plain relational SQL over the ``orders`` table: the derived ledger as a
CTE, joins, window ranking, GROUP BY and, for N:M, subsets enumerated by
joining members to a table of bit masks.  Nothing here runs on Spark, and the
rules under test are stated here on their own: keys, totalled amounts, date
rules and id prefix are written out per pass, not asked from the engine.
"""

from __future__ import annotations

import re
from dataclasses import replace

from matchbook.plans import catalog as C
from matchbook.plans.configs import CYCLE_DATE, GL_CR, SET_ID, m2m_pass, m2o_pass, o2m_pass, \
    o2o_pass, standard_spec
from matchbook.spec import CANONICAL_COLUMNS, MatchPass

WITHIN_FLOOR = 80
MGID_PREFIX = "MGID_USD_NOSTRO_CITIBANK_20240115_"

#: N:M passes whose large buckets all have an exact pair of at most so many rows a side.
SUBSET_ROWS = {"MP_M2M_SKIP": 2}

ACCOUNT = ("BANK_ACCOUNT", "BANK_ACCOUNT")
CCY = ("CURRENCY", "CURRENCY")
#: Join keys of each pass, written out: (left expression, right expression).
KEYS = {
    "MP_O2O": [ACCOUNT, ("AMOUNT", "AMOUNT"), CCY, ("REFERENCE", "REFERENCE")],
    "MP_O2M": [ACCOUNT, CCY], "MP_M2O": [ACCOUNT, CCY], "MP_M2M": [ACCOUNT, CCY],
    "MP_SUBSTR": [ACCOUNT, ("AMOUNT", "AMOUNT"), CCY],
    "MP_CONTAINS": [ACCOUNT, CCY], "MP_NUMERIC": [ACCOUNT, CCY], "MP_PERCENT": [ACCOUNT, CCY],
    "MP_DATEBAND": [ACCOUNT, CCY], "MP_AMTBAND": [ACCOUNT, CCY], "MP_HOT": [ACCOUNT, CCY],
    "MP_O2M_W": [ACCOUNT, CCY], "MP_M2M_PCT": [ACCOUNT, CCY], "MP_M2M_LARGE": [ACCOUNT, CCY],
    "MP_M2M_SKIP": [ACCOUNT, CCY], "MP_OVERLAP": [ACCOUNT, ("AMOUNT", "AMOUNT"), CCY],
    "MP_HOT_CONTAINS": [ACCOUNT, CCY],
    "MP_HOT_PERCENT": [ACCOUNT, CCY],
    "MP_LATTICE": [ACCOUNT, CCY],
    **{f"MP_O2M_{f}": [ACCOUNT, CCY] for f in ("COUNT", "MIN", "MAX", "AVG")},
    "MP_HOTFINE": [ACCOUNT, ("AMOUNT", "AMOUNT"), CCY, ("REFERENCE", "REFERENCE")],
}



def amount_rule(p: MatchPass):
    """The attribute that is totalled, or else the one over AMOUNT."""
    total = next((a for a in p.attributes if a.aggregation), None)
    return total or next(a for a in p.attributes if a.left == "AMOUNT" and a.right == "AMOUNT")


def date_rule(p: MatchPass):
    """The day tolerance over VALUE_DATE, if the pass has one."""
    return next((a for a in p.attributes if a.left == "VALUE_DATE" and a.tolerance_days), None)


LEDGER_SQL = """SELECT row_id, LS_TYPE, DR_CR_IND, STATUS, CAST(amt_raw AS DECIMAL(18,4)) AS AMOUNT, CURRENCY, VALUE_DATE, BANK_ACCOUNT, REFERENCE FROM (
WITH o AS (SELECT o_orderkey k, o_custkey c, CAST(ROUND(o_totalprice*100) AS BIGINT) cents, CAST(o_orderdate AS DATE) d,
  o_orderkey % 100 kind, 2 + o_orderkey % 3 parts FROM orders),
s AS (SELECT * FROM (VALUES (0),(1),(2),(3)) AS t(j)),
sides AS (SELECT * FROM (VALUES ('GL','CR',0),('STMT','DR',8)) AS u(ls,dc,base)),
n AS (SELECT o.*, ls, dc, base,
  CASE WHEN kind < 80 THEN 1
       WHEN kind < 88 THEN CASE WHEN ls='GL' THEN 1 ELSE parts END
       WHEN kind < 96 THEN CASE WHEN ls='GL' THEN parts ELSE 1 END
       WHEN kind = 96 THEN 2
       WHEN (ls='GL') = (k % 200 < 100) THEN 1 ELSE 0 END AS np
  FROM o CROSS JOIN sides)
SELECT k*16+base+j AS row_id, ls AS LS_TYPE, dc AS DR_CR_IND, 'OPEN' AS STATUS,
  CAST(CASE WHEN np=1 THEN cents
       WHEN j < np-1 THEN CAST(FLOOR(cents/GREATEST(np,1)) AS BIGINT) - (j+1)*(CASE WHEN ls='GL' THEN 7 ELSE 11 END)
       ELSE cents - (np-1)*CAST(FLOOR(cents/GREATEST(np,1)) AS BIGINT) + (CASE WHEN ls='GL' THEN 7 ELSE 11 END)*CAST((np-1)*np/2 AS BIGINT) END AS DECIMAL(18,4))/100 AS amt_raw,
  CASE c % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS CURRENCY,
  CAST(CASE WHEN kind BETWEEN 70 AND 79 AND ls='STMT' THEN d + INTERVAL 1 DAY ELSE d END AS DATE) AS VALUE_DATE,
  CASE WHEN kind < 80 OR kind >= 97 THEN 'NOSTRO-' || LPAD(CAST(c % 100 AS VARCHAR(10)),4,'0') ELSE 'NOSTRO-AGG-' || CAST(k AS VARCHAR(20)) END AS BANK_ACCOUNT,
  CASE WHEN np=1 THEN 'TRX-' || CAST(k AS VARCHAR(20)) ELSE 'TRX-' || CAST(k AS VARCHAR(20)) || '-' || CAST(j AS VARCHAR(2)) END AS REFERENCE
FROM n CROSS JOIN s WHERE j < np
) x"""

HOT_SQL = """SELECT row_id, LS_TYPE, DR_CR_IND, STATUS, AMOUNT, CURRENCY, VALUE_DATE,
  CASE WHEN BANK_ACCOUNT LIKE 'NOSTRO-0%' AND CAST(FLOOR(row_id / 16) AS BIGINT) % 3 = 0
       THEN 'NOSTRO-HOT' ELSE BANK_ACCOUNT END AS BANK_ACCOUNT, REFERENCE FROM ledger"""

ADVERSARIAL_SQL = """SELECT row_id, CASE WHEN row_id // 16 % 23 <> 0 THEN LS_TYPE END AS LS_TYPE, DR_CR_IND, STATUS,
  CAST(FLOOR(AMOUNT / 1000) * 1000 AS DECIMAL(18,4)) AS AMOUNT, CASE WHEN row_id // 16 % 19 <> 0 THEN CURRENCY END AS CURRENCY,
  CAST(date_trunc('month', VALUE_DATE) AS DATE) AS VALUE_DATE,
  CASE WHEN row_id // 16 % 17 <> 0 THEN CASE WHEN BANK_ACCOUNT LIKE 'NOSTRO-AGG-%' THEN 'NOSTRO-AGG-' || CAST(row_id // 16 % 397 AS VARCHAR) ELSE BANK_ACCOUNT END END AS BANK_ACCOUNT,
  CASE WHEN row_id // 16 % 13 <> 0 THEN 'TRX-' || CAST(row_id // 16 % 50 AS VARCHAR) END AS REFERENCE FROM ledger"""

FEE = "(row_id // 16 % 3 = 0 AND BANK_ACCOUNT LIKE 'NOSTRO-0%')"
HOT_FINE_SQL = f"""SELECT row_id, LS_TYPE, DR_CR_IND, STATUS, CASE WHEN {FEE} THEN CAST(25 AS DECIMAL(18,4)) ELSE AMOUNT END AS AMOUNT,
  CASE WHEN {FEE} THEN 'USD' ELSE CURRENCY END AS CURRENCY, VALUE_DATE,
  CASE WHEN {FEE} THEN 'NOSTRO-FEE' ELSE BANK_ACCOUNT END AS BANK_ACCOUNT, CASE WHEN {FEE} THEN 'FEE' ELSE REFERENCE END AS REFERENCE FROM ledger"""

SHARED_SQL = """SELECT row_id, LS_TYPE, DR_CR_IND, STATUS, AMOUNT, CURRENCY, VALUE_DATE,
  CASE WHEN BANK_ACCOUNT LIKE 'NOSTRO-AGG-%' THEN 'NOSTRO-AGG-' || CAST(row_id // 16 % 5 AS VARCHAR) ELSE BANK_ACCOUNT END AS BANK_ACCOUNT, REFERENCE FROM ledger"""

LEDGER_COLS = "row_id, LS_TYPE, DR_CR_IND, STATUS, AMOUNT, CURRENCY, VALUE_DATE, BANK_ACCOUNT, REFERENCE"
_COL_RE = re.compile(r"\b(" + "|".join(CANONICAL_COLUMNS) + r")\b")


def q(alias: str, expr: str) -> str:
    """Qualify the ledger columns of an attribute expression with a table alias."""
    return _COL_RE.sub(lambda m: f"{alias}.{m.group(1)}", expr)


def lit(attribute: str, v) -> str:
    if isinstance(v, str):
        s = "'" + v.replace("'", "''") + "'"
        return f"DATE {s}" if attribute == "VALUE_DATE" else s
    return repr(v)


def pop(alias: str, filters) -> str:
    parts = []
    for f in filters:
        c = f"{alias}.{f.attribute}"
        if f.operator == "IN":
            parts.append(f"{c} IN ({', '.join(lit(f.attribute, v) for v in f.value)})")
        elif f.operator == "LIKE":
            parts.append(f"CAST({c} AS VARCHAR) LIKE {lit('', f.value)}")
        else:
            parts.append(f"{c} {'<>' if f.operator == '!=' else f.operator} {lit(f.attribute, f.value)}")
    return "(" + (" AND ".join(parts) if parts else "TRUE") + ")"


def left_pop(alias, p: MatchPass) -> str:
    return pop(alias, p.left)


def right_pop(alias, p: MatchPass) -> str:
    return pop(alias, p.right)


def tol_sql(a, base: str) -> str:
    ta, tp = float(a.tolerance_amount or 0.0), float(a.tolerance_percent or 0.0)
    if tp == 0.0:
        return f"CAST({ta!r} AS DOUBLE)"
    return f"GREATEST(CAST({ta!r} AS DOUBLE), ABS(CAST({base} AS DOUBLE)) * {tp!r})"


def curve(delta: str, tol: str) -> str:
    return f"LEAST(100.0, GREATEST({float(WITHIN_FLOOR)}, 100.0 - {delta} / {tol} * 20.0))"


def attr_score(a, l: str, r: str) -> str:
    if a.operator == "EQUALS":
        return f"(CASE WHEN {l} = {r} THEN 100.0 ELSE 0.0 END)"
    if a.operator == "CONTAINS":
        return f"(CASE WHEN contains(CAST({l} AS VARCHAR), CAST({r} AS VARCHAR)) THEN 100.0 ELSE 0.0 END)"
    if a.is_date_band:
        d = f"CAST(ABS(datediff('day', {r}, {l})) AS DOUBLE)"
        t = float(a.tolerance_days)
        return f"(CASE WHEN {d} <= {t} THEN {curve(d, repr(t))} ELSE 0.0 END)"
    d = f"ABS(CAST({l} AS DOUBLE) - CAST({r} AS DOUBLE))"
    t = tol_sql(a, l)
    return f"(CASE WHEN {d} <= {t} THEN {curve(d, f'GREATEST({t}, 1e-12)')} ELSE 0.0 END)"


def within_sql(a, l: str, r: str) -> str:
    if a.is_date_band:
        return f"ABS(datediff('day', {r}, {l})) <= {a.tolerance_days}"
    return f"ABS(CAST({l} AS DOUBLE) - CAST({r} AS DOUBLE)) <= {tol_sql(a, l)}"


def o2o_candidates(p: MatchPass, src: str) -> str:
    keys = " AND ".join(f"{q('l', lk)} = {q('r', rk)}" for lk, rk in KEYS[p.id])
    where = [left_pop("l", p), right_pop("r", p), "l.row_id <> r.row_id"]
    for a in p.attributes:
        if a.operator == "WITHIN":
            where.append(within_sql(a, q("l", a.left), q("r", a.right)))
        elif a.operator == "CONTAINS":
            where.append(f"contains(CAST({q('l', a.left)} AS VARCHAR), CAST({q('r', a.right)} AS VARCHAR))")
    num = " + ".join(f"{attr_score(a, q('l', a.left), q('r', a.right))} * {float(a.weight)}"
                     for a in p.attributes)
    den = float(sum(a.weight for a in p.attributes))
    return (f"SELECT * FROM (SELECT l.row_id AS l_id, r.row_id AS r_id, "
            f"CAST(ROUND(({num}) / {den}, 0) AS BIGINT) AS q FROM {src} l JOIN {src} r ON {keys} "
            f"WHERE {' AND '.join(where)}) WHERE q >= {p.quality}")


def greedy(cands: str) -> str:
    return ("SELECT l_id, r_id, q FROM (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY q DESC, l_id) AS rn2 "
            "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY q DESC, r_id) AS rn1 "
            f"FROM ({cands})) WHERE rn1 = 1)) WHERE rn2 = 1")


def mgid(seq: str) -> str:
    return f"('{MGID_PREFIX}' || printf('%06d', {seq}))"


def pass_ctes(p: MatchPass, src: str, tag: str, offset: str) -> tuple[list[str], str, str]:
    """CTEs computing pass p over relation ``src``; returns (ctes, long-form
    relation name, numbered-groups relation name)."""
    g, n, lg = f"{tag}_groups", f"{tag}_num", f"{tag}_long"
    pid = f"'{p.id}'"
    if p.match_type == "ONE_TO_ONE":
        ctes = [f"{g} AS ({greedy(o2o_candidates(p, src))})",
                f"{n} AS (SELECT *, row_number() OVER (ORDER BY q DESC, r_id) + {offset} AS seq FROM {g})",
                f"{lg} AS (SELECT l_id AS row_id, {mgid('seq')} AS MATCHING_ID, {pid} AS MATCHED_BY_PASS, q AS MATCH_QUALITY FROM {n} "
                f"UNION ALL SELECT r_id, {mgid('seq')}, {pid}, q FROM {n})"]
        return ctes, lg, n
    if p.match_type in ("ONE_TO_MANY", "MANY_TO_ONE"):
        one_left = p.match_type == "ONE_TO_MANY"
        agg, da = amount_rule(p), date_rule(p)
        keys = KEYS[p.id]
        mk = [(rk if one_left else lk) for lk, rk in keys]
        ok = [(lk if one_left else rk) for lk, rk in keys]
        many_pop = right_pop("m", p) if one_left else left_pop("m", p)
        one_pop = left_pop("o", p) if one_left else right_pop("o", p)
        mv = agg.right if one_left else agg.left
        ov = agg.left if one_left else agg.right
        kcols = ", ".join(f"{q('m', e)} AS k{i}" for i, e in enumerate(mk))
        knames = ", ".join(f"k{i}" for i in range(len(keys)))
        dsel = (f", MIN({q('m', da.right if one_left else da.left)}) AS m_dmin, "
                f"MAX({q('m', da.right if one_left else da.left)}) AS m_dmax") if da else ""
        fn = agg.aggregation.function
        tot = f"COALESCE(SUM({q('m', mv)}), 0)" if fn == "SUM" else f"{fn}({q('m', mv)})"
        b = (f"SELECT {kcols}, {tot} AS m_sum, SUM({q('m', mv)}) AS m_all, COUNT({q('m', mv)}) AS m_vn{dsel}, COUNT(*) AS m_n "
             f"FROM {src} m WHERE {many_pop} GROUP BY ALL HAVING COUNT(*) >= 2")
        on = " AND ".join(f"{q('o', e)} = b.k{i}" for i, e in enumerate(ok))
        ovs = f"CAST({q('o', ov)} AS DOUBLE)"
        if agg.operator == "EQUALS":
            amt_ok, qual = f"{ovs} = CAST(b.m_sum AS DOUBLE)", "CAST(100 AS BIGINT)"
            if fn == "AVG":
                amt_ok = f"{q('o', ov)} * b.m_vn = b.m_all"
        else:
            dlt = f"ABS({ovs} - CAST(b.m_sum AS DOUBLE))"
            t = tol_sql(agg, q("o", ov))
            amt_ok = f"{dlt} <= {t}"
            qual = f"CAST(ROUND({curve(dlt, f'GREATEST({t}, 1e-12)')}, 0) AS BIGINT)"
        conds = [one_pop, amt_ok]
        if da:
            od = q("o", da.left if one_left else da.right)
            conds += [f"ABS(datediff('day', b.m_dmin, {od})) <= {da.tolerance_days}",
                      f"ABS(datediff('day', b.m_dmax, {od})) <= {da.tolerance_days}"]
        cand = (f"SELECT * FROM (SELECT o.row_id AS one_id, b.*, {qual} AS q FROM {src} o JOIN ({b}) b ON {on} "
                f"WHERE {' AND '.join(conds)}) WHERE q >= {p.quality}")
        mon = " AND ".join(f"{q('m', e)} = nn.k{i}" for i, e in enumerate(mk))
        ctes = [f"{g} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {knames} ORDER BY q DESC, one_id) AS rn FROM ({cand})) WHERE rn = 1)",
                f"{n} AS (SELECT *, row_number() OVER (ORDER BY q DESC, one_id) + {offset} AS seq FROM {g})",
                f"{lg} AS (SELECT one_id AS row_id, {mgid('seq')} AS MATCHING_ID, {pid} AS MATCHED_BY_PASS, q AS MATCH_QUALITY FROM {n} "
                f"UNION ALL SELECT m.row_id, {mgid('nn.seq')}, {pid}, nn.q FROM {src} m JOIN {n} nn ON {mon} WHERE {many_pop})"]
        return ctes, lg, n
    # MANY_TO_MANY
    amt, da = amount_rule(p), date_rule(p)
    keys = KEYS[p.id]
    knames = ", ".join(f"k{i}" for i in range(len(keys)))

    def members(side):
        al = "x"
        ks = ", ".join(f"{q(al, lk if side == 'l' else rk)} AS k{i}" for i, (lk, rk) in enumerate(keys))
        v = q(al, amt.left if side == "l" else amt.right)
        d = q(al, da.left if side == "l" else da.right) if da else "DATE '1970-01-01'"
        popc = left_pop(al, p) if side == "l" else right_pop(al, p)
        return (f"SELECT {ks}, {al}.row_id AS id, CAST({v} * 10000 AS BIGINT) AS u, {d} AS d "
                f"FROM {src} {al} WHERE {popc} AND {v} IS NOT NULL AND {d} IS NOT NULL")

    ta, tp = float(amt.tolerance_amount or 0.0), float(amt.tolerance_percent or 0.0)
    ls, rs = "CAST(l_sum AS DOUBLE) / 10000.0", "CAST(r_sum AS DOUBLE) / 10000.0"
    tol = f"GREATEST({ta!r}, ABS({ls}) * {tp!r})"
    dlt = f"ABS({ls} - {rs})"
    qual = (f"CAST(CASE WHEN {tol} <= 0 THEN (CASE WHEN {dlt} = 0 THEN 100 ELSE 0 END) "
            f"ELSE GREATEST({float(WITHIN_FLOOR)}, round_even(100.0 - {dlt} / GREATEST({tol}, 1e-12) * 20.0, 0)) END AS BIGINT)")
    date_ok = (f" AND datediff('day', LEAST(l_dmin, r_dmin), GREATEST(l_dmax, r_dmax)) <= {da.tolerance_days}"
               if da else "")
    # Small buckets (2..cap rows a side): all subsets by mask.  Large ones: subsets grown row by
    # row within the days, of up to SUBSET_ROWS rows where the pass names a bound (its buckets
    # all have an exact pair of so few rows).
    cap = p.max_bucket_side
    deep = f" AND g.n < {SUBSET_ROWS[p.id]}" if p.id in SUBSET_ROWS else ""
    td = da.tolerance_days if da else 0
    fits = f"a.n BETWEEN 2 AND {cap} AND b.n BETWEEN 2 AND {cap}"
    ctes = [f"{tag}_ml AS ({members('l')})", f"{tag}_mr AS ({members('r')})",
            f"{tag}_bk AS (SELECT {knames}, {fits} AS small FROM (SELECT {knames}, COUNT(*) n FROM {tag}_ml GROUP BY ALL) a "
            f"JOIN (SELECT {knames}, COUNT(*) n FROM {tag}_mr GROUP BY ALL) b USING ({knames}) WHERE a.n >= 2 AND b.n >= 2)"]
    for s in ("l", "r"):
        ctes.append(f"{tag}_p{s} AS (SELECT m.*, row_number() OVER (PARTITION BY {knames} ORDER BY id) - 1 AS pos, "
                    f"COUNT(*) OVER (PARTITION BY {knames}) AS n FROM {tag}_m{s} m JOIN (SELECT * FROM {tag}_bk WHERE small) USING ({knames}))")
        ctes.append(f"{tag}_s{s} AS (SELECT {knames}, mask AS {s}_mask, SUM(u) AS {s}_sum, MIN(d) AS {s}_dmin, "
                    f"MAX(d) AS {s}_dmax, COUNT(*) AS {s}_cnt, list(id ORDER BY id DESC) AS {s}_ids "
                    f"FROM {tag}_p{s} JOIN (SELECT range AS mask FROM range(3, {1 << cap})) mm "
                    f"ON (mask >> pos) & 1 = 1 AND mask < (1 << n) GROUP BY ALL HAVING COUNT(*) >= 2)")
        ctes.append(f"{tag}_b{s} AS (SELECT m.* FROM {tag}_m{s} m JOIN (SELECT * FROM {tag}_bk WHERE NOT small) USING ({knames}))")
        ctes.append(f"{tag}_g{s} AS (SELECT {knames}, id AS hi, [id] AS ids, u AS s, d AS dmin, d AS dmax, 1 AS n FROM {tag}_b{s} "
                    f"UNION ALL SELECT {', '.join(f'g.k{i}' for i in range(len(keys)))}, m.id, [m.id] || g.ids, g.s + m.u, "
                    f"LEAST(g.dmin, m.d), GREATEST(g.dmax, m.d), g.n + 1 FROM {tag}_g{s} g JOIN {tag}_b{s} m USING ({knames}) "
                    f"WHERE m.id > g.hi AND datediff('day', LEAST(g.dmin, m.d), GREATEST(g.dmax, m.d)) <= {td}{deep})")
        ctes.append(f"{tag}_t{s} AS (SELECT {knames}, s AS {s}_sum, dmin AS {s}_dmin, dmax AS {s}_dmax, n AS {s}_cnt, ids AS {s}_ids "
                    f"FROM {tag}_g{s} WHERE n >= 2)")
    ctes.append(f"{tag}_small AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {knames} ORDER BY q DESC, "
                f"l_cnt + r_cnt, l_mask DESC, r_mask DESC) AS rn FROM (SELECT *, {qual} AS q FROM {tag}_sl "
                f"JOIN {tag}_sr USING ({knames}) WHERE {dlt} <= {tol}{date_ok}) WHERE q >= {p.quality}) WHERE rn = 1)")
    ctes.append(f"{tag}_met AS (SELECT *, GREATEST(l_dmax, r_dmax) AS dmx FROM (SELECT *, {qual} AS q FROM {tag}_tl "
                f"JOIN {tag}_tr USING ({knames}) WHERE {dlt} <= {tol}{date_ok}) WHERE q >= {p.quality} "
                f"QUALIFY rank() OVER (PARTITION BY {knames} ORDER BY q DESC, l_cnt + r_cnt) = 1)")
    ctes.append(f"{tag}_days AS (SELECT {knames}, d AS day FROM {tag}_bl UNION SELECT {knames}, d FROM {tag}_br)")
    ctes.append(f"{tag}_large AS (SELECT * FROM (SELECT m.*, day, row_number() OVER (PARTITION BY {knames} "
                f"ORDER BY day, l_ids DESC, r_ids DESC) AS rn FROM (SELECT {knames}, q, l_ids, r_ids, dmx, MIN(day) AS day FROM {tag}_met "
                f"JOIN {tag}_days USING ({knames}) WHERE datediff('day', day, dmx) <= {td} GROUP BY ALL) m) WHERE rn = 1)")
    ctes.append(f"{g} AS (SELECT {knames}, l_mask, r_mask, l_ids, r_ids, q, MIN(id) AS lmin FROM {tag}_small "
                f"JOIN {tag}_pl USING ({knames}) GROUP BY ALL UNION ALL "
                f"SELECT {knames}, NULL, NULL, l_ids, r_ids, q, MIN(id) FROM {tag}_large JOIN {tag}_bl USING ({knames}) "
                f"WHERE datediff('day', day, d) BETWEEN 0 AND {td} GROUP BY ALL)")
    ctes.append(f"{n} AS (SELECT *, row_number() OVER (ORDER BY q DESC, lmin) + {offset} AS seq FROM {g})")
    ctes.append(f"{lg} AS (SELECT unnest(l_ids || r_ids) AS row_id, {mgid('seq')} AS MATCHING_ID, {pid} AS MATCHED_BY_PASS, "
                f"q AS MATCH_QUALITY FROM {n})")
    return ctes, lg, n


def carry_sql() -> str:
    """Two cycles, written out: the second takes what the first left open."""
    spec = standard_spec()
    first, m1 = run_ctes(spec, "a_", with_base=False, src="led1")
    second, m2 = run_ctes(spec, "b_", with_base=False, src="led2")
    cols = LEDGER_COLS
    c1, c2 = (f"DATE '{c}'" for c in C.CYCLES)
    new = f"CASE WHEN VALUE_DATE <= {c1} THEN {c1} ELSE {c2} END"
    return with_ctes(
        BASE + [f"led1 AS (SELECT {cols} FROM ledger WHERE VALUE_DATE <= {c1})"] + first
        + [f"led2 AS (SELECT {cols} FROM ledger WHERE row_id NOT IN (SELECT row_id FROM {m1}))"] + second,
        f"SELECT row_id, {new} AS first_seen, "
        f"CASE WHEN a.row_id IS NOT NULL THEN {c1} WHEN b.row_id IS NOT NULL THEN {c2} END AS matched_in, "
        f"CASE WHEN a.row_id IS NULL AND VALUE_DATE <= {c1} THEN 1 ELSE 0 END AS age, "
        f"COALESCE(a.MATCHED_BY_PASS, b.MATCHED_BY_PASS) AS MATCHED_BY_PASS, "
        f"COALESCE(a.MATCH_QUALITY, b.MATCH_QUALITY) AS MATCH_QUALITY "
        f"FROM ledger LEFT JOIN {m1} a USING (row_id) LEFT JOIN {m2} b USING (row_id)")


def suspects_sql() -> str:
    ctes, m = run_ctes(C.SUSPECT_SPEC, "a_", with_base=False, src="adv")
    rules = [p for p in C.SUSPECT_SPEC.active_passes() if p.match_type == "ONE_TO_ONE"]
    made = " UNION ALL ".join(
        f"SELECT *, {k} AS k, '{p.id}' AS pass_id FROM ({greedy(o2o_candidates(replace(p, quality=C.SUSPECT_FLOOR), 'rest'))})"
        for k, p in enumerate(rules))
    order = "q DESC, k, LEAST(l_id, r_id), GREATEST(l_id, r_id)"
    return with_ctes(
        BASE + [f"adv AS ({ADVERSARIAL_SQL})"] + ctes
        + [f"rest AS (SELECT * FROM adv WHERE row_id NOT IN (SELECT row_id FROM {m}))", f"made AS ({made})",
           f"roles AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY {order}) AS n FROM "
           "(SELECT *, unnest([l_id, r_id]) AS r FROM made))",
           "won AS (SELECT l_id, r_id, q, k, pass_id FROM roles WHERE n = 1 GROUP BY ALL HAVING COUNT(*) = 2)"],
        "SELECT row_number() OVER (ORDER BY q DESC, k, l_id, r_id) AS suspect_rank, l_id, r_id, q AS quality, pass_id FROM won")


def partial_sql(p: MatchPass) -> str:
    """1:N or N:1 against parts of a bucket: every subset of the rows within the days of a
    target, by mask; each target's best one, accepted if all its rows have no better one."""
    one_left = p.match_type == "ONE_TO_MANY"
    agg, days = amount_rule(p), date_rule(p).tolerance_days
    one, many = ("left", "right") if one_left else ("right", "left")
    side = {"left": left_pop("x", p), "right": right_pop("x", p)}
    tol = "0.0" if agg.operator == "EQUALS" else tol_sql(agg, "v")
    delta = "ABS(CAST(v AS DOUBLE) - CAST(total AS DOUBLE))"
    qual = "CAST(100 AS BIGINT)" if agg.operator == "EQUALS" else \
        f"CAST(ROUND({curve(delta, f'GREATEST({tol}, 1e-12)')}, 0) AS BIGINT)"
    return with_ctes(BASE + [
        f"shared AS ({SHARED_SQL})",
        f"one AS (SELECT row_id AS one_id, BANK_ACCOUNT, CURRENCY, AMOUNT AS v, VALUE_DATE AS td FROM shared x WHERE {side[one]})",
        f"many AS (SELECT row_id AS id, BANK_ACCOUNT, CURRENCY, AMOUNT AS u, VALUE_DATE AS d FROM shared x WHERE {side[many]})",
        "cells AS (SELECT BANK_ACCOUNT, CURRENCY, td, MAX(v) AS top FROM one GROUP BY ALL)",
        f"cell AS (SELECT *, row_number() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY BANK_ACCOUNT, CURRENCY, td) AS n "
        f"FROM cells JOIN many USING (BANK_ACCOUNT, CURRENCY) WHERE ABS(datediff('day', d, td)) <= {days} AND u <= top * 1.01 + 100 "
        f"WINDOW w AS (PARTITION BY BANK_ACCOUNT, CURRENCY, td ORDER BY id))",
        "sums AS (SELECT BANK_ACCOUNT, CURRENCY, td, mask, SUM(u) AS total, COUNT(*) AS rows, list(id ORDER BY id DESC) AS ids "
        "FROM cell JOIN (SELECT range AS mask FROM range(3, 1 << (SELECT MAX(n) FROM cell))) mm ON (mask >> pos) & 1 = 1 AND mask < (1 << n) "
        "GROUP BY ALL HAVING COUNT(*) >= 2)",
        f"made AS (SELECT one_id, {qual} AS q, rows, ids, mask FROM one JOIN sums USING (BANK_ACCOUNT, CURRENCY, td) "
        f"WHERE {delta} <= {tol} QUALIFY row_number() OVER (PARTITION BY one_id ORDER BY q DESC, rows, mask DESC) = 1 AND q >= {p.quality})",
        "claims AS (SELECT one_id, row_number() OVER (PARTITION BY id ORDER BY q DESC, rows, one_id) AS rn FROM "
        "(SELECT one_id, q, rows, unnest(ids) AS id FROM made))",
        "won AS (SELECT one_id FROM claims GROUP BY one_id HAVING MAX(rn) = 1)",
        "num AS (SELECT *, row_number() OVER (ORDER BY q DESC, one_id) AS seq FROM made JOIN won USING (one_id))"],
        f"SELECT unnest([one_id] || ids) AS row_id, {mgid('seq')} AS MATCHING_ID, '{p.id}' AS MATCHED_BY_PASS, q AS MATCH_QUALITY FROM num")


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


BASE = [f"ledger AS ({LEDGER_SQL})"]


def run_ctes(spec, prefix: str = "", with_base: bool = True,
             src: str = "ledger") -> tuple[list[str], str]:
    """Chained passes over relation ``src``; returns CTEs and the name of the
    all-passes long form."""
    ctes = list(BASE) if with_base else []
    longs, nums = [], []
    for k, p in enumerate(spec.active_passes()):
        offset = " + ".join(f"(SELECT COUNT(*) FROM {x})" for x in nums) or "0"
        c, lg, n = pass_ctes(p, src, f"{prefix}p{k}", offset)
        ctes += c
        longs.append(lg)
        nums.append(n)
        nxt = f"{prefix}rem{k}"
        ctes.append(f"{nxt} AS (SELECT * FROM {src} WHERE row_id NOT IN (SELECT row_id FROM {lg}))")
        src = nxt
    ctes.append(f"{prefix}matches AS (" + " UNION ALL ".join(f"SELECT * FROM {x}" for x in longs) + ")")
    return ctes, f"{prefix}matches"


RESULT_SELECT = (f"SELECT l.row_id, l.LS_TYPE, l.DR_CR_IND, CASE WHEN m.MATCHING_ID IS NOT NULL THEN 'MATCHED' ELSE 'UNMATCHED' END AS STATUS, "
                 f"l.AMOUNT, l.CURRENCY, l.VALUE_DATE, l.BANK_ACCOUNT, l.REFERENCE, "
                 f"CASE WHEN m.MATCHING_ID IS NOT NULL THEN DATE '{CYCLE_DATE}' END AS MATCH_DATE, m.MATCHING_ID, m.MATCHED_BY_PASS, m.MATCH_QUALITY "
                 f"FROM ledger l LEFT JOIN matches m USING (row_id)")


def result_ctes(spec=None) -> list[str]:
    ctes, _ = run_ctes(spec or standard_spec())
    return ctes + [f"result AS ({RESULT_SELECT})"]


def _single(p: MatchPass, body_kind: str) -> str:
    ctes = list(BASE)
    c, lg, n = pass_ctes(p, "ledger", "p", "0")
    ctes += c
    if body_kind == "long":
        return with_ctes(ctes, f"SELECT * FROM {lg}")
    return with_ctes(ctes, f"SELECT * FROM {n}")


def _pairs(p: MatchPass, greedy_: bool = True, src: str = "ledger", extra=()) -> str:
    cands = o2o_candidates(p, src)
    return with_ctes(list(BASE) + list(extra), greedy(cands) if greedy_ else cands)


def totals_sql(spec=None) -> str:
    return with_ctes(result_ctes(spec), "SELECT COUNT(*) AS input_rows, COUNT(MATCHING_ID) AS matched_rows, "
                     "CAST(COALESCE(SUM(CASE WHEN MATCHING_ID IS NULL THEN 1 END), 0) AS BIGINT) AS unmatched_rows, "
                     "COUNT(DISTINCT MATCHING_ID) AS match_groups FROM result")


def page_sql(status: str, filters: dict, limit: int, offset: int) -> str:
    conds = [f"STATUS = '{status}'"]
    from matchbook.plans.browse import FILTER_COLUMNS
    for k, v in filters.items():
        if k in FILTER_COLUMNS:
            conds.append(f"{FILTER_COLUMNS[k]} = '{v}'")
    w = " AND ".join(conds)
    return with_ctes(result_ctes() + [f"f AS (SELECT * FROM result WHERE {w})"],
                     f"SELECT (SELECT COUNT(*) FROM f) AS page_total, CAST({limit} AS BIGINT) AS page_limit, "
                     f"CAST({offset} AS BIGINT) AS page_offset, * FROM f ORDER BY row_id LIMIT {limit} OFFSET {offset}")


def history_sql() -> str:
    from matchbook.spec import RunSpec
    a_ctes, ma = run_ctes(RunSpec(set_id=SET_ID, cycle_date=CYCLE_DATE, passes=(o2o_pass(),)), "a_")
    b_ctes, mb = run_ctes(standard_spec(), "b_", with_base=False)

    def tot(run_id, started, cfg, m):
        return (f"SELECT '{run_id}' AS run_id, '{cfg}' AS config_id, '{SET_ID}' AS set_id, '{started}' AS started_at, "
                f"(SELECT COUNT(*) FROM ledger) AS input_rows, (SELECT COUNT(*) FROM {m}) AS matched_rows, "
                f"(SELECT COUNT(*) FROM ledger) - (SELECT COUNT(*) FROM {m}) AS unmatched_rows, "
                f"(SELECT COUNT(DISTINCT MATCHING_ID) FROM {m}) AS match_groups")
    (ra, sa, ca), (rb, sb, cb) = C.HISTORY_RUNS
    return with_ctes(a_ctes + b_ctes, tot(ra, sa, ca, ma) + " UNION ALL " + tot(rb, sb, cb, mb))


def overlap_sql() -> str:
    """Both orientations, the better one of a mirrored pair, best right per left, best left
    per right, and then a pair only where it is the best of both rows in either role."""
    once = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY LEAST(l_id, r_id), GREATEST(l_id, r_id) "
            f"ORDER BY q DESC, l_id) AS one FROM ({o2o_candidates(C.OVERLAP_PASS, 'adv')})) WHERE one = 1")
    return with_ctes(BASE + [f"adv AS ({ADVERSARIAL_SQL})", f"g AS ({greedy(once)})",
                             "roles AS (SELECT l_id, r_id, q, l_id AS r FROM g UNION ALL SELECT l_id, r_id, q, r_id FROM g)",
                             "best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY q DESC, LEAST(l_id, r_id), GREATEST(l_id, r_id), l_id) AS n FROM roles)"],
                     "SELECT l_id, r_id, q FROM best WHERE n = 1 GROUP BY ALL HAVING COUNT(*) = 2")


def manifest_sql() -> str:
    ctes, m = run_ctes(standard_spec(), "a_", with_base=False, src="adv")
    open_items = lambda c, kind: (f"SELECT '{kind}', COALESCE({c}, '(null)'), COUNT(*) FROM adv "  # noqa: E731
                                  f"WHERE row_id NOT IN (SELECT row_id FROM {m}) GROUP BY 2")
    return with_ctes(
        BASE + [f"adv AS ({ADVERSARIAL_SQL})"] + ctes,
        f"SELECT 'total' AS kind, 'input_rows' AS key, (SELECT COUNT(*) FROM adv) AS value "
        f"UNION ALL SELECT 'total', 'matched_rows', (SELECT COUNT(*) FROM {m}) "
        f"UNION ALL SELECT 'total', 'unmatched_rows', (SELECT COUNT(*) FROM adv) - (SELECT COUNT(*) FROM {m}) "
        f"UNION ALL SELECT 'total', 'match_groups', (SELECT COUNT(DISTINCT MATCHING_ID) FROM {m}) "
        f"UNION ALL {open_items('LS_TYPE', 'side')} UNION ALL {open_items('CURRENCY', 'currency')} "
        f"UNION ALL SELECT 'groups', x.id, (SELECT COUNT(DISTINCT MATCHING_ID) FROM {m} WHERE MATCHED_BY_PASS = x.id) "
        f"FROM (VALUES ('MP_O2O'), ('MP_O2M'), ('MP_M2O'), ('MP_M2M')) AS x(id)")


def oracle_sql() -> dict[str, str]:
    spec = standard_spec()
    res = lambda body: with_ctes(result_ctes(), body)
    o2m = o2m_pass()
    m2m = m2m_pass()
    kn, kk = "BANK_ACCOUNT, CURRENCY", "k0, k1"
    out = {
        "ledger_scan": with_ctes(BASE, "SELECT * FROM ledger"),
        "population_eq": with_ctes(BASE, f"SELECT * FROM ledger l WHERE {pop('l', GL_CR)}"),
        "population_in_like": with_ctes(BASE, f"SELECT * FROM ledger l WHERE {pop('l', C.POP_IN_LIKE)}"),
        "population_compare": with_ctes(BASE, f"SELECT * FROM ledger l WHERE {pop('l', C.POP_COMPARE)}"),
        "attr_substring": _pairs(C.SUBSTRING_PASS, greedy_=False),
        "attr_contains": _pairs(C.CONTAINS_PASS),
        "within_numeric": _pairs(C.NUMERIC_PASS),
        "within_percent": _pairs(C.PERCENT_PASS),
        "pair_scores": _pairs(o2o_pass(quality=0), greedy_=False),
        "o2o_candidates": _pairs(o2o_pass(), greedy_=False),
        "o2o_pairs": with_ctes(BASE + pass_ctes(o2o_pass(), "ledger", "p", "0")[0],
                               f"SELECT l_id, r_id, q, seq, {mgid('seq')} AS MATCHING_ID FROM p_num"),
        "o2o_long": _single(o2o_pass(), "long"),
        "o2o_date_band": _pairs(C.DATE_BAND_PASS),
        "o2o_amount_band": _pairs(C.AMOUNT_BAND_PASS),
        "o2o_hot_account": _pairs(C.HOT_PASS, src="hot", extra=[f"hot AS ({HOT_SQL})"]),
        "contains_hot_account": _pairs(C.HOT_CONTAINS_PASS, src="hot", extra=[f"hot AS ({HOT_SQL})"]),
        "percent_hot_account": _pairs(C.HOT_PERCENT_PASS, greedy_=False, src="hot", extra=[f"hot AS ({HOT_SQL})"]),
        "o2m_buckets": with_ctes(BASE, f"SELECT {kn}, CAST(COALESCE(SUM(AMOUNT), 0) AS DECIMAL(28,4)) AS m_sum, MIN(VALUE_DATE) AS m_dmin, "
                                       f"MAX(VALUE_DATE) AS m_dmax, COUNT(*) AS m_n FROM ledger m WHERE {right_pop('m', o2m)} "
                                       f"GROUP BY {kn} HAVING COUNT(*) >= 2"),
        "o2m_groups": _single(o2m, "long"),
        "o2m_within_quality": _single(C.O2M_WITHIN_PASS, "long"),
        "o2m_partial": partial_sql(C.PARTIAL_O2M_PASS),
        "m2o_partial_within": partial_sql(C.PARTIAL_M2O_PASS),
        "o2m_count": _single(C.TOTAL_PASSES["COUNT"], "long"),
        "o2m_min": _single(C.TOTAL_PASSES["MIN"], "long"),
        "o2m_max": _single(C.TOTAL_PASSES["MAX"], "long"),
        "o2m_avg": _single(C.TOTAL_PASSES["AVG"], "long"),
        "carried_items": carry_sql(),
        "suspected_pairs": suspects_sql(),
        "m2o_groups": _single(m2o_pass(), "long"),
        "m2m_buckets": with_ctes(BASE, f"SELECT {kn}, a.n AS n_left, b.n AS n_right, "
                                       f"(a.n BETWEEN 2 AND 10 AND b.n BETWEEN 2 AND 10) AS eligible FROM "
                                       f"(SELECT {kn}, COUNT(*) n FROM ledger l WHERE {left_pop('l', m2m)} AND AMOUNT IS NOT NULL AND VALUE_DATE IS NOT NULL GROUP BY ALL) a JOIN "
                                       f"(SELECT {kn}, COUNT(*) n FROM ledger r WHERE {right_pop('r', m2m)} AND AMOUNT IS NOT NULL AND VALUE_DATE IS NOT NULL GROUP BY ALL) b USING ({kn})"),
        "m2m_subsets": with_ctes(BASE + pass_ctes(m2m, "ledger", "p", "0")[0],
                                 "SELECT k0 AS BANK_ACCOUNT, k1 AS CURRENCY, l_mask, r_mask, q FROM p_groups"),
        "m2m_groups": _single(m2m, "long"),
        "m2m_large_bucket": _single(C.M2M_LARGE_PASS, "long"),
        "m2m_searched": _single(C.M2M_SKIP_PASS, "long"),
        "m2m_skipped": "SELECT BANK_ACCOUNT, CURRENCY, n AS n_left, n AS n_right FROM "
                       "(SELECT '' AS BANK_ACCOUNT, '' AS CURRENCY, COUNT(*) AS n FROM orders) WHERE FALSE",
        "m2m_large_windows": with_ctes(
            BASE + pass_ctes(C.M2M_SKIP_PASS, "ledger", "p", "0")[0] + [
                f"w{s} AS (SELECT {kk}, win, COUNT(*) AS n FROM (SELECT {kk}, unnest(range(d - DATE '1970-01-01' - 150, "
                f"d - DATE '1970-01-01' + 1)) AS win FROM p_b{s}) GROUP BY ALL)" for s in ("l", "r")],
            f"SELECT k0 AS BANK_ACCOUNT, k1 AS CURRENCY, day AS \"window\", wl.n AS n_left, wr.n AS n_right FROM wl JOIN wr "
            f"USING ({kk}, win) JOIN p_days USING ({kk}) WHERE win = day - DATE '1970-01-01' AND wl.n >= 2 AND wr.n >= 2 "
            f"AND NOT (wl.n <= 6 AND wr.n <= 6)"),
        "o2o_overlap": overlap_sql(),
        "o2o_hot_fine_key": _pairs(C.HOT_FINE_PASS, src="fee", extra=[f"fee AS ({HOT_FINE_SQL})"]),
        "o2o_lattice": _pairs(C.LATTICE_PASS, src="hot", extra=[f"hot AS ({HOT_SQL})"]),
        "adversarial_matches": with_ctes(
            BASE + [f"adv AS ({ADVERSARIAL_SQL})"] + run_ctes(spec, "a_", with_base=False, src="adv")[0],
            f"SELECT *, DATE '{CYCLE_DATE}' AS MATCH_DATE FROM a_matches"),
        "run_manifest": manifest_sql(),
        "population_mixed_types": with_ctes(
            BASE, "SELECT * FROM (SELECT *, row_id % 1000 AS QTY FROM ledger) WHERE QTY < 500.5 AND QTY <> 7.25 "
                  "AND AMOUNT > 100000.00005 AND VALUE_DATE >= DATE '1995-06-01' AND QTY >= 3"),
        "parquet_load": with_ctes(
            BASE, f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {LEDGER_COLS.removeprefix('row_id, ')} FROM ledger"),
        "matches_page_deep": page_sql("MATCHED", {}, 100, C.DEEP_OFFSET),
        "m2m_percent_groups": _single(C.M2M_PERCENT_PASS, "long"),
        "passes_matches": with_ctes(run_ctes(spec)[0], f"SELECT *, DATE '{CYCLE_DATE}' AS MATCH_DATE FROM matches"),
        "hot_passes_matches": with_ctes(
            BASE + [f"hot AS ({HOT_SQL})"] + run_ctes(spec, "h_", with_base=False, src="hot")[0],
            f"SELECT *, DATE '{CYCLE_DATE}' AS MATCH_DATE FROM h_matches"),
        "passes_remaining": with_ctes(run_ctes(spec)[0], "SELECT * FROM ledger WHERE row_id NOT IN (SELECT row_id FROM matches)"),
        "recon_result": res("SELECT * FROM result"),
        "run_totals": totals_sql(),
        "pass_breakdown": with_ctes(run_ctes(spec)[0] + [
            "plist AS (SELECT * FROM (VALUES " + ", ".join(
                f"('{p.id}', '{p.display_name}', '{p.match_type}', {p.rule_order})" for p in spec.active_passes())
            + ") AS t(pass_id, pass_name, match_type, rule_order))"],
            "SELECT pass_id, pass_name, match_type, CAST(rule_order AS BIGINT) AS rule_order, "
            "CAST(COALESCE(g, 0) AS BIGINT) AS matched_groups, CAST(COALESCE(n, 0) AS BIGINT) AS matched_rows, "
            "CAST(COALESCE(a, 0.0) AS DOUBLE) AS avg_quality FROM plist LEFT JOIN (SELECT MATCHED_BY_PASS AS pass_id, "
            "COUNT(DISTINCT MATCHING_ID) AS g, COUNT(*) AS n, ROUND(AVG(MATCH_QUALITY), 2) AS a FROM matches GROUP BY 1) USING (pass_id)"),
        "unmatched_by_side": res("SELECT LS_TYPE, COUNT(*) AS unmatched_rows FROM result WHERE MATCHING_ID IS NULL GROUP BY 1"),
        "unmatched_by_currency": res("SELECT CURRENCY, COUNT(*) AS unmatched_rows FROM result WHERE MATCHING_ID IS NULL GROUP BY 1"),
        "match_rate": res("SELECT COUNT(*) AS input_rows, COUNT(MATCHING_ID) AS matched_rows, CASE WHEN COUNT(*) > 0 "
                          "THEN ROUND(COUNT(MATCHING_ID) * 100.0 / COUNT(*), 2) ELSE 0.0 END AS match_rate_pct FROM result"),
        "matches_page": page_sql("MATCHED", C.MATCHES_FILTERS, 100, 50),
        "matches_page_indexed": page_sql("MATCHED", C.INDEXED_FILTERS, 100, C.INDEXED_OFFSET),
        "output_order": res("SELECT row_id, MATCHING_ID, row_number() OVER (ORDER BY row_id) - 1 AS place FROM result"),
        "run_order": f"SELECT run_id, started_at, matched_rows, row_number() OVER (ORDER BY started_at DESC, run_id) AS place FROM ({history_sql()})",
        "breaks_page": page_sql("UNMATCHED", C.BREAKS_FILTERS, 100, 0),
        "run_history": history_sql(),
        "csv_roundtrip": res("SELECT row_id, AMOUNT, VALUE_DATE, BANK_ACCOUNT, STATUS, CAST(AMOUNT AS VARCHAR) AS AMOUNT_TEXT, "
                             "CURRENCY, REFERENCE, strftime(MATCH_DATE, '%Y-%m-%d') AS MATCH_DATE, MATCHING_ID, MATCHED_BY_PASS, "
                             "CAST(MATCH_QUALITY AS VARCHAR) AS MATCH_QUALITY FROM result"),
        "run_detail": res(
            f"SELECT '{C.RUN_META[0]}' AS run_id, '{SET_ID}' AS set_id, '{C.RUN_META[1]}' AS config_id, "
            f"DATE '{CYCLE_DATE}' AS cycle_date, '{C.RUN_META[2]}' AS requested_cycle_date, "
            f"'{C.RUN_META[3]}' AS started_at, COUNT(*) AS input_rows, COUNT(MATCHING_ID) AS matched_rows, "
            f"COUNT(*) - COUNT(MATCHING_ID) AS unmatched_rows, COUNT(DISTINCT MATCHING_ID) AS match_groups, "
            f"CAST({len(spec.active_passes())} AS INTEGER) AS n_passes, "
            f"COUNT(*) FILTER (WHERE MATCHING_ID IS NULL AND LS_TYPE = 'GL') AS unmatched_gl, "
            f"COUNT(*) FILTER (WHERE MATCHING_ID IS NULL AND LS_TYPE = 'STMT') AS unmatched_stmt FROM result"),
    }
    return out
