"""SQL for DuckDB that gives the unit cases from the same alias lines, by joins and exact integers."""

from __future__ import annotations

from orderloom.operators.units import LOOSE_PACKAGES, unit_rows

NUMBER = "[0-9][0-9.,'']*"


def decimal(x: str) -> str:
    """Number of a text as the notation rules say."""
    bare = f"regexp_replace({x}, '[A-Za-z$€£₹¥\\s()''+-]', '', 'g')"
    return f"""CASE WHEN trim({x}) LIKE '-%' OR trim({x}) LIKE '%-' OR trim({x}) LIKE '(%)' THEN -1 ELSE 1 END * TRY_CAST(CASE
        WHEN NOT regexp_matches({bare}, '[0-9]') OR regexp_matches({bare}, '[^0-9.,]') THEN NULL
        WHEN {bare} LIKE '%,%' AND {bare} LIKE '%.%' AND regexp_matches({bare}, ',[^.]*$') THEN replace(replace({bare}, '.', ''), ',', '.')
        WHEN {bare} LIKE '%,%' AND {bare} LIKE '%.%' THEN replace({bare}, ',', '')
        WHEN regexp_matches({bare}, '^[0-9]{{1,3}}(,[0-9]{{3}})+$') THEN replace({bare}, ',', '')
        WHEN {bare} LIKE '%,%' THEN replace(regexp_extract({bare}, '^(.*),([^,]*)$', 1), ',', '') || '.' || regexp_extract({bare}, '^(.*),([^,]*)$', 2)
        WHEN {bare} LIKE '%.%.%' THEN replace({bare}, '.', '') ELSE {bare} END AS DECIMAL(20,8))"""


def key(x: str) -> str:
    return f"nullif(regexp_replace(lower({x}), '[\\s.]+', '', 'g'), '')"


def in_base(value: str, num: str, den: str) -> str:
    """value * num / den in ten-thousandths, rounded half up."""
    top, bottom = f"(CAST(abs({value}) * 100000000 AS HUGEINT) * {num})", f"({den} * 10000)"
    return f"CAST(CASE WHEN {value} < 0 THEN -1 ELSE 1 END * ((2 * {top} + {bottom}) // (2 * {bottom})) AS BIGINT)"


def unit_cases_sql() -> str:
    values = ", ".join(f"('{a}', '{b}', '{k}', {n}, {d})" for a, b, k, n, d, _ in unit_rows())
    loose = ", ".join(f"'{x}'" for x in LOOSE_PACKAGES)
    times, multiple, content = rf"^(?i:x|×|\*)\s*({NUMBER})\s*(.*?)(?i:\s+each)?$", rf"^({NUMBER})\s*(.*)$", rf"^([^0-9]+?)\s*(?i:\bof|à|@|/)?\s*({NUMBER})\s*(.*?)(?i:\s+each)?$"
    price = r"^(.*?)(?:\s*/\s*|\s+(?i:per|je|pro|por|par|à)\s+)(.*)$"
    lead = r"^(\(?\s*[+-]?\s*[.,]?[0-9][0-9.,''\s]*\)?-?)(.*)$"
    hint = r"(?i)(?:\(qty in ([^()]+)\)|\[uom ([^\[\]]+)\]|; menge in (.+)|, counted by the (.+)|- sold per (.+))\s*$"
    hints = ", ".join(f"nullif(regexp_extract(n, '{hint}', {i}), '')" for i in range(1, 6))
    phrase = lambda slot, x: f"SELECT id, base_unit, pack_size, '{slot}' AS slot, nullif(trim({x}), '') AS p FROM lines"
    unit = lambda slot, part: f"max({part}) FILTER (WHERE slot = '{slot}')"
    return f"""WITH units(alias, base, kind, num, den) AS (VALUES {values}),
    lines AS (SELECT i.id, c.base_unit, c.pack_size, replace(i.quantity, chr(160), ' ') AS q, replace(i.unit_of_measure, chr(160), ' ') AS u, i.part_name AS n, replace(i.unit_price, chr(160), ' ') AS pr
        FROM purchase_order_items i JOIN part_catalog c ON c.part_number = i.part_number),
    phrases AS ({phrase('q', f"CASE WHEN regexp_matches(q, '{lead}') THEN regexp_extract(q, '{lead}', 2) END")} UNION ALL {phrase('u', 'u')} UNION ALL {phrase('n', f'coalesce({hints})')}
        UNION ALL {phrase('p', f"CASE WHEN regexp_matches(pr, '{price}') THEN regexp_extract(pr, '{price}', 2) END")}),
    shaped AS (SELECT *, CASE WHEN regexp_matches(p, '{times}') THEN 't' WHEN regexp_matches(p, '{multiple}') THEN 'm' WHEN regexp_matches(p, '{content}') THEN 'c' END AS shape FROM phrases WHERE p IS NOT NULL),
    cut AS (SELECT *, {key('p')} AS k_all, CASE WHEN shape = 'c' THEN {key(f"regexp_extract(p, '{content}', 1)")} END AS k_out,
        {key(f"CASE shape WHEN 't' THEN regexp_extract(p, '{times}', 2) WHEN 'm' THEN regexp_extract(p, '{multiple}', 2) WHEN 'c' THEN regexp_extract(p, '{content}', 3) END")} AS k_in,
        CASE shape WHEN 't' THEN regexp_extract(p, '{times}', 1) WHEN 'm' THEN regexp_extract(p, '{multiple}', 1) WHEN 'c' THEN regexp_extract(p, '{content}', 2) END AS c_text FROM shaped),
    counted AS (SELECT *, CAST({decimal('c_text')} * 10000 AS HUGEINT) AS cnt, CAST(pack_size * 10000 AS HUGEINT) AS pack FROM cut),
    joined AS (SELECT x.*, a.kind AS a_kind, a.num AS a_num, a.den AS a_den, o.kind AS o_kind, i.kind AS i_kind, i.num AS i_num, i.den AS i_den, i.alias AS i_alias FROM counted x
        LEFT JOIN units a ON a.alias = x.k_all AND a.base = x.base_unit LEFT JOIN units o ON o.alias = x.k_out AND o.base = x.base_unit LEFT JOIN units i ON i.alias = x.k_in AND i.base = x.base_unit),
    known AS (SELECT id, slot, CASE WHEN a_kind = 'package' THEN pack WHEN a_kind IS NOT NULL THEN a_num
            WHEN (shape = 't' OR shape = 'c' AND (o_kind = 'package' OR k_out IN ({loose}))) AND (k_in IS NULL OR i_alias IS NOT NULL) THEN cnt * coalesce(i_num, 1)
            WHEN shape = 'm' AND k_in IS NULL THEN cnt WHEN shape = 'm' AND i_kind = 'package' THEN cnt * pack // 10000 WHEN shape = 'm' AND i_alias IS NOT NULL THEN cnt * i_num END::HUGEINT AS num,
        CASE WHEN a_kind = 'package' THEN 10000 WHEN a_kind IS NOT NULL THEN CAST(a_den AS HUGEINT) WHEN shape = 'm' AND (k_in IS NULL OR i_kind = 'package') THEN 10000 ELSE CAST(10000 AS HUGEINT) * coalesce(i_den, 1) END::HUGEINT AS den,
        CASE WHEN a_kind IS NOT NULL THEN a_kind = 'base' WHEN shape = 'm' THEN cnt = 10000 AND (k_in IS NULL OR i_kind = 'base') ELSE false END AS is_base FROM joined),
    units_of AS (SELECT id, {', '.join(f"{unit(s, c)} AS {s}_{c}" for s in 'qunp' for c in ('num', 'den', 'is_base'))} FROM known WHERE num IS NOT NULL GROUP BY id),
    amounts AS (SELECT l.id, CASE WHEN regexp_matches(q, '{lead}') THEN {decimal(f"regexp_extract(q, '{lead}', 1)")} END AS qty, {decimal(f"CASE WHEN regexp_matches(pr, '{price}') THEN regexp_extract(pr, '{price}', 1) ELSE pr END")} AS price,
        coalesce(q_num, u_num, n_num, 1) AS l_num, CASE WHEN q_num IS NOT NULL THEN q_den WHEN u_num IS NOT NULL THEN u_den WHEN n_num IS NOT NULL THEN n_den ELSE 1 END AS l_den,
        CASE WHEN q_num IS NOT NULL THEN q_is_base WHEN u_num IS NOT NULL THEN u_is_base WHEN n_num IS NOT NULL THEN n_is_base ELSE true END AS l_base, p_num, p_den, p_is_base
        FROM lines l LEFT JOIN units_of USING (id))
    SELECT id AS item_id, 'quantity' AS measure, {in_base('qty', 'l_num', 'l_den')} AS value_e4 FROM amounts WHERE NOT l_base AND qty IS NOT NULL
    UNION ALL SELECT id, 'unit_price', {in_base('price', 'coalesce(p_den, l_den)', 'coalesce(p_num, l_num)')} FROM amounts WHERE NOT coalesce(p_is_base, l_base) AND price IS NOT NULL"""
