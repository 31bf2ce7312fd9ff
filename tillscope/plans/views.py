"""SQL for the checks: named building blocks as common table expressions."""

from __future__ import annotations

# Parameters on the test tables.
ANALYSIS_DATE = "2001-08-01"
CUTOFF = "1999-01-01"
MAX_DAYS = 16

ITEM_SUPPORT, ITEM_CONFIDENCE = 0.004, 0.09
PRUNE_CONFIDENCE = 0.08
GROUP_SUPPORT, GROUP_CONFIDENCE = 0.05, 0.45

VALUE = "order_value_ex_vat_ex_freight"

BLOCKS = {
    "orderlines": """
        SELECT CAST(o.o_orderdate AS DATE) AS date,
               CAST(l.l_orderkey AS VARCHAR) AS order_id,
               CAST(o.o_custkey AS VARCHAR) AS customer_id,
               CAST(l.l_partkey AS VARCHAR) AS product_id,
               p.p_name AS product_title,
               CAST(c.c_nationkey AS VARCHAR) AS customer_zip_code,
               p.p_type AS product_group_level_1,
               p.p_brand AS product_category_level_2,
               l.l_extendedprice * (1 - l.l_discount) AS order_value_ex_vat_ex_freight
        FROM lineitem l
        JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN part p ON p.p_partkey = l.l_partkey""",
    "orderlines_raw": """
        SELECT CASE l.l_orderkey % 3 WHEN 0 THEN strftime(o.o_orderdate, '%d.%m.%Y')
                    WHEN 1 THEN strftime(o.o_orderdate, '%d-%m-%Y')
                    ELSE strftime(o.o_orderdate, '%-d/%-m/%Y') END AS date,
               CAST(l.l_orderkey AS VARCHAR) AS order_id,
               CAST(o.o_custkey AS VARCHAR) AS customer_id,
               CAST(l.l_partkey AS VARCHAR) AS product_id,
               CASE WHEN l.l_orderkey % 77 = 3 THEN NULL ELSE p.p_name END AS product_title,
               CASE WHEN l.l_orderkey % 50 = 0 THEN NULL
                    ELSE CAST(c.c_nationkey AS VARCHAR) END AS customer_zip_code,
               CASE WHEN l.l_partkey % 10 = 0 THEN lower(p.p_type)
                    ELSE p.p_type END AS product_group_level_1,
               p.p_brand AS product_category_level_2,
               CASE WHEN l.l_discount >= 0.095 THEN -1.0
                    WHEN l.l_tax = 0 AND l.l_quantity <= 2 THEN 0.0
                    ELSE l.l_extendedprice * (1 - l.l_discount)
               END AS order_value_ex_vat_ex_freight
        FROM lineitem l
        JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN part p ON p.p_partkey = l.l_partkey""",
    "complete": """
        SELECT * FROM orderlines_raw
        WHERE product_title IS NOT NULL AND customer_zip_code IS NOT NULL""",
    "item_margin": """
        SELECT p.p_name AS item, 0.30 + 200 * (avg(l.l_discount) - 0.05) AS margin
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
        GROUP BY p.p_name""",
    "some_margins": "SELECT * FROM item_margin WHERE item NOT LIKE 'blue %'",
    "items": "SELECT DISTINCT order_id, product_title AS item FROM orderlines",
    "groups": "SELECT DISTINCT order_id, product_group_level_1 AS item FROM orderlines",
    "customers": f"""
        SELECT customer_id,
               date_diff('day', max(date), DATE '{ANALYSIS_DATE}') AS recency,
               count(DISTINCT order_id) AS frequency,
               sum({VALUE}) AS monetary
        FROM orderlines GROUP BY customer_id""",
    "measures": f"""
        SELECT customer_id,
               date_diff('day', max(date), DATE '{ANALYSIS_DATE}') AS recency_days,
               count(*) AS transaction_count,
               sum({VALUE}) AS amount
        FROM orderlines GROUP BY customer_id""",
    "sameday": f"""
        SELECT customer_id AS cust, date, sum({VALUE}) AS sales
        FROM orderlines GROUP BY customer_id, date""",
    "eventlog": f"""
        SELECT s.* FROM sameday s
        WHERE cust NOT IN (SELECT customer_id FROM orderlines GROUP BY customer_id
                           HAVING min(date) >= DATE '{CUTOFF}')
          AND cust IN (SELECT cust FROM sameday GROUP BY cust HAVING count(*) < {MAX_DAYS})""",
    "cbs": f"""
        SELECT cust, count(*) - 1 AS x,
               date_diff('day', min(date), max(date)) / 7.0::DOUBLE AS t_x,
               date_diff('day', min(date), DATE '{CUTOFF}' - 1) / 7.0::DOUBLE AS t_cal,
               avg(sales) AS m_x
        FROM eventlog WHERE date < DATE '{CUTOFF}' GROUP BY cust""",
    "holdout": f"""
        SELECT cust, avg(sales) AS holdout_mean, count(*) AS holdout_count
        FROM eventlog WHERE date >= DATE '{CUTOFF}' GROUP BY cust""",
}

NEEDS = {
    "complete": ["orderlines_raw"],
    "items": ["orderlines"],
    "groups": ["orderlines"],
    "customers": ["orderlines"],
    "measures": ["orderlines"],
    "sameday": ["orderlines"],
    "eventlog": ["sameday"],
    "cbs": ["eventlog"],
    "holdout": ["eventlog"],
}


def sql(use: str, final: str, **own: str) -> str:
    """``WITH`` the named blocks (and what they need), own blocks, then the query."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in use.split():
        add(name)
    parts = [f"{name} AS ({BLOCKS[name]})" for name in order]
    parts += [f"{name} AS ({body})" for name, body in own.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + final


def itemset_blocks(source: str, support: float, max_length: int) -> dict[str, str]:
    """Level-wise itemset mining in SQL over ``(order_id, item)``."""
    threshold = f"(SELECT ceil({support} * count(DISTINCT order_id)) FROM {source})"
    blocks = {
        "frequent": f"""SELECT order_id, item FROM {source} WHERE item IN
            (SELECT item FROM {source} GROUP BY item HAVING count(*) >= {threshold})""",
        "n_all": f"SELECT count(DISTINCT order_id) AS n FROM {source}",
    }
    blocks["held1"] = "SELECT order_id, [item] AS items, item AS last FROM frequent"
    levels = []
    for length in range(1, max_length + 1):
        if length > 1:
            # Only sets whose first items are frequent together can be.
            blocks[f"held{length}"] = f"""
                SELECT h.order_id, list_append(h.items, f.item) AS items, f.item AS last
                FROM held{length - 1} h JOIN level{length - 1} l ON l.items = h.items
                JOIN frequent f ON f.order_id = h.order_id AND f.item > h.last"""
        blocks[f"level{length}"] = (
            f"SELECT items, count(*) AS count FROM held{length} "
            f"GROUP BY items HAVING count(*) >= {threshold}"
        )
        levels.append(f"SELECT * FROM level{length}")
    blocks["itemsets"] = " UNION ALL ".join(levels)
    return blocks


def rule_blocks(source: str, support: float, confidence: float, max_length: int) -> dict[str, str]:
    """Rules with one consequent item, in SQL, on top of ``itemset_blocks``."""
    blocks = itemset_blocks(source, support, max_length)
    blocks["halves"] = """
        SELECT items, count, unnest(items) AS consequent FROM itemsets WHERE len(items) > 1"""
    blocks["rules"] = f"""
        SELECT h.items, a.items AS antecedent, h.consequent,
               '{{' || array_to_string(a.items, ',') || '}} => {{' || h.consequent || '}}' AS rule,
               h.count / n.n AS support, h.count / a.count AS confidence,
               a.count / n.n AS coverage,
               (h.count / a.count) / (c.count / n.n) AS lift, h.count
        FROM halves h
        JOIN itemsets a ON a.items = list_filter(h.items, lambda i: i <> h.consequent)
        JOIN itemsets c ON c.items = [h.consequent]
        CROSS JOIN n_all n
        WHERE h.count / a.count >= {confidence}"""
    return blocks


PRUNED = """
    SELECT r.* FROM rules r WHERE
        (SELECT count(*) FROM rules o WHERE list_has_all(r.items, o.items)) = 1"""


def quantile(values: str, p: float) -> str:
    """Linear interpolation in a sorted list, as a SQL expression."""
    h = f"({p} * (len({values}) - 1))"
    low, high = f"{values}[CAST(floor({h}) AS BIGINT) + 1]", f"{values}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"({low} + ({high} - {low}) * ({h} - floor({h})))"
