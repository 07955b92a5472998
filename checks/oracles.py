"""DuckDB text of every registered query that SQL can express.

Each text starts from the driver tables. ``_with`` strings together the common table
expressions a query needs, in order of dependency.
"""

from __future__ import annotations

# name -> (CTEs it depends on, body)
_CTE: dict[str, tuple[list[str], str]] = {}
_RECURSIVE: set[str] = set()


def _cte(name: str, needs: list[str], body: str, recursive: bool = False) -> None:
    _CTE[name] = (needs, body)
    if recursive:
        _RECURSIVE.add(name)


def _with(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    parts = [
        f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({_CTE[n][1]})" for n in order
    ]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


_cte(
    "behaviors",
    [],
    """
    SELECT CAST(e.ts AS VARCHAR) AS eventTime, e.ts AS event_time,
           CASE WHEN e.event_type = 'click' THEN 'cart' ELSE e.event_type END AS event_type,
           CAST(p.p_partkey AS VARCHAR) AS product_id, CAST(e.user_id AS VARCHAR) AS user_id,
           concat(e.user_id, '-', CAST(e.ts AS DATE)) AS user_session,
           concat(CASE WHEN p_size <= 25 THEN 'electronics.' ELSE 'home.' END, lower(p_type))
             AS category_code,
           p_brand AS brand, p_name AS name, p_retailprice AS price, e.event_id
    FROM events e JOIN part p
      ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
    """,
)
_cte(
    "clean",
    ["behaviors"],
    """
    SELECT event_time, event_type, product_id, user_id, user_session,
           replace(category_code, '.', ' ') AS category_code, brand, name, price, event_id
    FROM behaviors
    WHERE event_time IS NOT NULL AND event_type <> '0' AND product_id <> '0' AND user_id <> '0'
      AND user_session <> '0' AND category_code <> '0' AND brand <> '0' AND name <> '0'
      AND price <> 0
    """,
)
_cte(
    "counted",
    ["clean"],
    """
    SELECT *, """
    + ", ".join(
        f"count(*) FILTER (WHERE event_type = '{t}') OVER (PARTITION BY user_id, user_session)"
        f" AS total_{t}, count(*) FILTER (WHERE event_type = '{t}')"
        f" OVER (PARTITION BY user_id, user_session, product_id) AS is_{t}"
        for t in ("view", "cart", "purchase")
    )
    + " FROM clean",
)
_cte(
    "gaps",
    ["counted"],
    """
    SELECT *, coalesce(epoch_us(event_time) - lag(epoch_us(event_time)) OVER (
             PARTITION BY user_id, user_session ORDER BY event_time, event_id), 0) / 1e6 AS duration
    FROM (SELECT * EXCLUDE (event_id), min(event_id) AS event_id FROM counted GROUP BY ALL)
    """,
)
_cte(
    "spans",
    ["gaps"],
    """SELECT *, sum(duration) OVER (PARTITION BY user_id, user_session) AS total_duration
       FROM gaps""",
)
_cte(
    "features",
    ["spans"],
    """
    SELECT *,
      CASE WHEN total_view = 0 THEN 0 ELSE is_view / total_view END AS F1,
      CASE WHEN total_cart = 0 THEN 0 ELSE is_cart / total_cart END AS F2,
      CASE WHEN total_purchase = 0 THEN 0 ELSE is_purchase / total_purchase END AS F3,
      CASE WHEN total_duration = 0 THEN 0 ELSE duration / total_duration END AS F4
    FROM spans
    """,
)
_cte(
    "scores",
    ["features"],
    """SELECT user_id, product_id, sum(0.1*F1 + 0.3*F2 + 0.4*F3 + 0.2*F4) AS score
       FROM features GROUP BY ALL""",
)
_cte(
    "catalog",
    [],
    """
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, lower(p_type) AS category,
           p_type AS type, p_brand AS brand, p_retailprice AS price,
           concat(p_name, ' ', p_type, ' size ', p_size) AS description
    FROM part
    """,
)

ORACLES: dict[str, str] = {}

ORACLES["clean_events"] = _with(
    ["clean"], "SELECT * EXCLUDE (event_time), epoch_us(event_time) AS event_us FROM clean"
)
ORACLES["session_features"] = _with(
    ["features"],
    f"""SELECT event_id, user_id, user_session, product_id, event_type, total_view, total_cart,
        total_purchase, is_view, is_cart, is_purchase, {r6('duration')} AS duration,
        {r6('total_duration')} AS total_duration, {r6('F1')} AS F1, {r6('F2')} AS F2,
        {r6('F3')} AS F3, {r6('F4')} AS F4 FROM features""",
)
ORACLES["encoded_features"] = _with(
    ["features"],
    f"""SELECT event_id, CAST(dense_rank() OVER (ORDER BY product_id) - 1 AS BIGINT) AS product_id,
        CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_id,
        CAST(dense_rank() OVER (ORDER BY user_session) - 1 AS BIGINT) AS user_session,
        event_type, total_view, is_view, {r6('duration')} AS duration, {r6('F1')} AS F1,
        {r6('F2')} AS F2, {r6('F3')} AS F3, {r6('F4')} AS F4 FROM features""",
)
ORACLES["user_product_scores"] = _with(
    ["scores"], f"SELECT user_id, product_id, {r6('score')} AS score FROM scores"
)
ORACLES["trending"] = _with(
    ["scores", "catalog"],
    f"""SELECT c.product_id, c.name, c.category, c.type, c.brand, c.price, c.description,
        {r6('t.trending_score')} AS trending_score
        FROM catalog c LEFT JOIN (SELECT product_id, sum(score) AS trending_score FROM scores
        GROUP BY product_id) t ON t.product_id = c.product_id""",
)
ORACLES["profile"] = _with(
    ["behaviors", "clean"],
    " UNION ALL ".join(
        f"""SELECT '{stage}' AS stage, count(*) AS n_rows, count(DISTINCT user_id) AS n_users,
        count(DISTINCT product_id) AS n_products FROM {src}"""
        for stage, src in (
            ("raw", "behaviors"),
            ("clean", "clean"),
            ("first_touch", "(SELECT DISTINCT user_id, product_id FROM clean)"),
        )
    ),
)
ORACLES["prefix_filter"] = _with(
    ["clean"],
    """SELECT event_id, product_id, category_code FROM clean
       WHERE starts_with(category_code, 'electronics')""",
)
ORACLES["product_details"] = _with(
    ["clean"],
    """SELECT product_id, name, category_code, brand FROM clean
       QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY event_time, event_id) = 1""",
)
ORACLES["recent_sessions"] = _with(
    ["clean"],
    """SELECT DISTINCT c.product_id, user_session, CAST(cutoff AS VARCHAR) AS cutoff
       FROM clean c JOIN (SELECT product_id, max(event_time) - INTERVAL 3 MONTH AS cutoff
                          FROM clean GROUP BY product_id) m USING (product_id)
       WHERE event_time >= cutoff""",
)

# ---- sampling, numbering, sessions --------------------------------------------------------
_cte("sessions", ["clean"], "SELECT DISTINCT user_session FROM clean")
ORACLES["sample_fraction"] = _with(
    ["sessions"],
    """SELECT user_session FROM sessions
       QUALIFY row_number() OVER (ORDER BY md5(concat('42:', user_session)))
               <= round_even(0.3 * (SELECT count(*) FROM sessions), 0)""",
)
ORACLES["label_encode"] = _with(
    ["clean"],
    """SELECT event_id, CAST(dense_rank() OVER (ORDER BY product_id) - 1 AS BIGINT) AS product_id,
       CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_id,
       CAST(dense_rank() OVER (ORDER BY user_session) - 1 AS BIGINT) AS user_session
       FROM clean""",
)
_cte("members", ["clean"], "SELECT DISTINCT user_session, product_id FROM clean")
_cte(
    "cooc",
    ["members"],
    """SELECT a.product_id AS target, b.product_id AS candidate, count(*) AS freq
       FROM members a JOIN members b USING (user_session) WHERE a.product_id <> b.product_id
       GROUP BY ALL""",
)


def _clusters(top: int, rnd: int) -> None:
    _cte(
        f"ranked_{top}",
        ["cooc"],
        """SELECT *, row_number() OVER (PARTITION BY target ORDER BY freq DESC, candidate) AS rk
           FROM cooc""",
    )
    _cte(
        f"clusters_{top}_{rnd}",
        [f"ranked_{top}", "clean"],
        f"""
        SELECT target, 'top' AS bucket, rk AS rank, candidate, freq FROM ranked_{top}
        WHERE rk <= {top}
        UNION ALL
        SELECT target, 'others', row_number() OVER (PARTITION BY target ORDER BY
               md5(concat('42:', target, ':', candidate))) AS rank, candidate, freq
        FROM ranked_{top} WHERE rk > {top} QUALIFY rank <= {rnd}
        UNION ALL
        SELECT DISTINCT product_id, NULL, NULL, NULL, NULL FROM clean
        WHERE product_id NOT IN (SELECT target FROM cooc)
        """,
    )


_clusters(8, 5)
_clusters(5, 2)
ORACLES["cooccurrence"] = _with(["cooc"], "SELECT * FROM cooc")
ORACLES["coldstart_clusters"] = _with(["clusters_8_5"], "SELECT * FROM clusters_8_5")
ORACLES["incremental_clusters"] = _with(["clusters_8_5"], "SELECT * FROM clusters_8_5")
_cte(
    "cluster_of",
    ["clusters_8_5", "catalog"],
    """SELECT product_id AS target, coalesce(
         (SELECT min(target) FROM clusters_8_5 c WHERE c.target = k.product_id),
         (SELECT min(target) FROM clusters_8_5 c WHERE c.candidate = k.product_id)) AS cluster
       FROM catalog k""",
)
ORACLES["cluster_for_target"] = _with(["cluster_of"], "SELECT * FROM cluster_of")

# ---- vectors, points, artifacts -----------------------------------------------------------
# Model names made of the event table: one name per hour of events, and untimed ones.
_cte(
    "names",
    ["behaviors"],
    r"""
    SELECT DISTINCT concat(event_type, '_', strftime(event_time, '%d_%m_%y_%H_%M'), '.pkl') AS name
    FROM behaviors WHERE event_type IN ('view', 'cart')
    UNION SELECT DISTINCT concat(event_type, '_99_99_99_', user_id, '.pkl') FROM behaviors
    WHERE event_type IN ('view', 'purchase')
    """,
)
ORACLES["latest_artifact"] = _with(
    ["names"],
    r"""
    SELECT prefix, coalesce(max_by(name, (stamp, name)) FILTER (WHERE stamp IS NOT NULL), max(name),
           any_value(concat(prefix, '_default'))) AS name
    FROM (SELECT p.prefix, n.name, try_strptime(nullif(regexp_extract(n.name,
            concat(p.prefix, '_(\d{2}_\d{2}_\d{2}_\d{2}_\d{2})\.pkl'), 1), ''),
            '%d_%m_%y_%H_%M') AS stamp
          FROM (VALUES ('view'), ('cart'), ('purchase'), ('error_model')) p(prefix)
          LEFT JOIN names n ON starts_with(n.name, p.prefix))
    GROUP BY prefix
    """,
)

# ---- baskets, itemsets, rules, carts ------------------------------------------------------
_cte(
    "brand_lines",
    [],
    """SELECT CAST(l_orderkey AS VARCHAR) AS user_session, p_brand AS product_id
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)


def _baskets(prefix: str, source: str) -> None:
    _cte(
        f"{prefix}_counts",
        [source],
        f"""SELECT user_session AS basket, product_id AS item, count(*) AS n FROM {source}
            GROUP BY ALL""",
    )
    _cte(
        f"{prefix}_sizes",
        [f"{prefix}_counts"],
        f"""SELECT basket, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_items
            FROM {prefix}_counts GROUP BY ALL HAVING sum(n) > 1""",
    )
    _cte(
        f"{prefix}_ids",
        [f"{prefix}_sizes"],
        f"""SELECT basket FROM {prefix}_sizes
            QUALIFY row_number() OVER (ORDER BY md5(concat('42:', basket)))
                    <= round_even(0.3 * (SELECT count(*) FROM {prefix}_sizes), 0)""",
    )


_baskets("session", "clean")
_baskets("brand", "brand_lines")
ORACLES["baskets"] = _with(
    ["session_sizes", "session_ids"], "SELECT * FROM session_sizes SEMI JOIN session_ids USING (basket)"
)
_cte(
    "brand_sampled",
    ["brand_lines", "brand_ids"],
    """SELECT user_session AS basket, product_id AS item, count(*) AS n FROM brand_lines
       WHERE user_session IN (SELECT basket FROM brand_ids) GROUP BY ALL""",
)
_cte(
    "brand_often",
    ["brand_sampled"],
    """SELECT item, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS n_baskets
       FROM brand_sampled GROUP BY ALL HAVING sum(n) >= 5""",
)
ORACLES["frequent_items"] = _with(["brand_often"], "SELECT * FROM brand_often")
_cte(
    "basket_items",
    ["brand_sampled", "brand_often"],
    "SELECT basket, item FROM brand_sampled WHERE item IN (SELECT item FROM brand_often)",
)
ORACLES["basket_items"] = _with(["basket_items"], "SELECT * FROM basket_items")
_cte("min_freq", ["brand_ids"], "SELECT ceil(0.001 * count(*)) AS m FROM brand_ids")
# Every round adds one item to the frequent sets of a basket; the recursion ends by itself when no
# set is frequent any more. All baskets' copies of a set carry its count.
_cte(
    "grown",
    ["basket_items", "min_freq"],
    """
    SELECT basket, items, last, freq FROM (
      SELECT basket, [item] AS items, item AS last, count(*) OVER (PARTITION BY item) AS freq
      FROM basket_items) WHERE freq >= (SELECT m FROM min_freq)
    UNION ALL
    SELECT basket, items, last, freq FROM (
      SELECT basket, items, last, count(*) OVER (PARTITION BY items) AS freq FROM (
        SELECT g.basket, list_append(g.items, b.item) AS items, b.item AS last
        FROM grown g JOIN basket_items b ON b.basket = g.basket AND b.item > g.last))
    WHERE freq >= (SELECT m FROM min_freq)
    """,
    recursive=True,
)
_cte("itemsets", ["grown"], "SELECT items, any_value(freq) AS freq FROM grown GROUP BY items")
ORACLES["frequent_itemsets"] = _with(
    ["itemsets"], "SELECT array_to_string(items, ',') AS items, len(items) AS size, freq FROM itemsets"
)
_cte(
    "rules",
    ["itemsets", "brand_ids"],
    """
    SELECT a.items AS antecedent, x.c AS consequent, x.freq / (SELECT count(*) FROM brand_ids)
             AS support, x.freq / a.freq AS confidence,
           (x.freq / a.freq) / (c.freq / (SELECT count(*) FROM brand_ids)) AS lift,
           round((x.freq / a.freq) * ((x.freq / a.freq) / (c.freq /
             (SELECT count(*) FROM brand_ids))), 6) AS score
    FROM (SELECT items, freq, unnest(items) AS c FROM itemsets WHERE len(items) > 1) x
    JOIN itemsets a ON a.items = list_filter(x.items, lambda i: i <> x.c)
    JOIN itemsets c ON c.items = [x.c]
    WHERE x.freq / a.freq >= 0.08
    """,
)
ORACLES["basket_rules"] = _with(
    ["rules"],
    f"""SELECT array_to_string(antecedent, ',') AS antecedent, consequent, {r6('support')} AS support,
        {r6('confidence')} AS confidence, {r6('lift')} AS lift, {r6('score')} AS score FROM rules""",
)
ORACLES["basket_rules_all"] = _with(
    ["itemsets", "brand_ids"],
    f"""SELECT array_to_string(a.items, ',') AS antecedent, array_to_string(c.items, ',') AS consequent,
        {r6('x.freq / n')} AS support, {r6('x.freq / a.freq')} AS confidence,
        {r6('(x.freq / a.freq) / (c.freq / n)')} AS lift, {r6('x.freq / n - a.freq / n * (c.freq / n)')} AS leverage
        FROM itemsets x, itemsets a, itemsets c, (SELECT count(*)::DOUBLE AS n FROM brand_ids)
        WHERE len(a.items) < len(x.items) AND list_has_all(x.items, a.items)
          AND c.items = list_filter(x.items, lambda i: NOT list_contains(a.items, i))
          AND x.freq / a.freq >= 0.08""",
)
_cte("cart_items", ["brand_lines"], "SELECT DISTINCT user_session AS cart, product_id AS item FROM brand_lines")
_cte("rule_ids", ["rules"], "SELECT row_number() OVER () AS rid, * FROM rules")
_cte(
    "matches",
    ["rule_ids", "cart_items"],
    """
    SELECT m.cart, r.antecedent, r.consequent, r.score FROM (
      SELECT c.cart, e.rid FROM (SELECT rid, unnest(antecedent) AS item FROM rule_ids) e
      JOIN cart_items c USING (item) JOIN rule_ids r ON r.rid = e.rid
      GROUP BY c.cart, e.rid HAVING count(*) = any_value(len(r.antecedent))) m
    JOIN rule_ids r USING (rid)
    ANTI JOIN cart_items x ON x.cart = m.cart AND x.item = r.consequent
    """,
)
ORACLES["cart_matches"] = _with(
    ["matches"],
    f"""SELECT cart, count(*) AS n_rules, count(DISTINCT consequent) AS n_products,
        {r6('max(score)')} AS best_score, {r6('sum(score)')} AS total_score
        FROM matches GROUP BY cart""",
)
_cte(
    "pool",
    ["rules"],
    """SELECT consequent, max(score) AS score FROM rules GROUP BY 1
       ORDER BY 2 DESC, 1 LIMIT 200""",
)
ORACLES["cart_recommend"] = _with(
    ["matches", "pool", "cart_items"],
    """
    SELECT cart, row_number() OVER (PARTITION BY cart ORDER BY tier, score DESC, consequent) AS rank,
           consequent AS product_id
    FROM (
      SELECT cart, 1 AS tier, consequent, max(score) AS score FROM matches GROUP BY ALL
      UNION ALL
      SELECT c.cart, 2, p.consequent, p.score FROM (SELECT DISTINCT cart FROM cart_items) c, pool p
      ANTI JOIN cart_items x ON x.cart = c.cart AND x.item = p.consequent
      ANTI JOIN matches m ON m.cart = c.cart AND m.consequent = p.consequent)
    QUALIFY rank <= 5
    """,
)

# ---- offsets, splits, evaluation ----------------------------------------------------------


def _baselines(prefix: str, ratings: str, epochs: int = 10, group: str = "") -> None:
    """Offsets of ``ratings`` (user_id, product_id, score); ``group`` fits one model per value."""
    g = f"{group}, " if group else ""
    on = f"({g}user_id)", f"({g}product_id)"
    mean_on = f"USING ({group})" if group else "ON true"
    _cte(
        f"{prefix}_mu",
        [ratings],
        f"""SELECT {g} avg(score) AS mu, min(score) AS lo, max(score) AS hi
            FROM {ratings} {'GROUP BY ' + group if group else ''}""",
    )
    last = None
    for e in range(1, epochs + 1):
        if last is None:
            src = f"FROM {ratings} r JOIN {prefix}_mu m {mean_on}"
            term = "r.score - m.mu"
        else:
            src = f"FROM {ratings} r JOIN {prefix}_mu m {mean_on} JOIN {last} u USING {on[0]}"
            term = "r.score - m.mu - u.b_u"
        _cte(
            f"{prefix}_i{e}",
            [ratings, f"{prefix}_mu"] + ([last] if last else []),
            f"SELECT {g} product_id, sum({term}) / (10 + count(*)) AS b_i {src} GROUP BY ALL",
        )
        _cte(
            f"{prefix}_u{e}",
            [ratings, f"{prefix}_mu", f"{prefix}_i{e}"],
            f"""SELECT {g} user_id, sum(r.score - m.mu - i.b_i) / (15 + count(*)) AS b_u
                FROM {ratings} r JOIN {prefix}_mu m {mean_on} JOIN {prefix}_i{e} i USING {on[1]}
                GROUP BY ALL""",
        )
        last = f"{prefix}_u{e}"
    _cte(f"{prefix}_items", [f"{prefix}_i{epochs}"], f"SELECT * FROM {prefix}_i{epochs}")
    _cte(f"{prefix}_users", [f"{prefix}_u{epochs}"], f"SELECT * FROM {prefix}_u{epochs}")


_baselines("all", "scores")
ORACLES["rating_scale"] = _with(
    ["scores"], f"SELECT {r6('min(score)')} AS min_score, {r6('max(score)')} AS max_score FROM scores"
)
_cte(
    "all_est",
    ["scores", "all_mu", "all_users", "all_items"],
    """SELECT user_id, product_id, score, b_u, b_i, mu + b_u + b_i AS raw,
         least(greatest(mu + b_u + b_i, lo), hi) AS est
       FROM scores JOIN all_users USING (user_id) JOIN all_items USING (product_id), all_mu""",
)
ORACLES["bias_scores"] = _with(
    ["all_est"],
    f"""SELECT user_id, product_id, {r6('b_u')} AS b_u, {r6('b_i')} AS b_i, {r6('est')} AS est
        FROM all_est""",
)
ORACLES["rating_errors"] = _with(
    ["all_est"],
    f"""SELECT {r6('sqrt(avg((score - est) * (score - est)))')} AS rmse,
        {r6('avg(abs(score - est))')} AS mae FROM all_est""",
)
ORACLES["model_users"] = _with(["scores"], "SELECT DISTINCT user_id FROM scores")
_cte(
    "truth",
    ["clean"],
    "SELECT DISTINCT user_id, product_id FROM clean WHERE event_type = 'purchase'",
)
_cte(
    "eligible",
    ["truth"],
    "SELECT user_id, count(*) AS total_buy FROM truth GROUP BY 1 HAVING count(*) >= 3",
)
ORACLES["eligible_users"] = _with(["eligible"], "SELECT * FROM eligible")
_cte(
    "held_out",
    ["eligible"],
    """SELECT user_id FROM eligible
       QUALIFY row_number() OVER (ORDER BY md5(concat('42:', user_id)))
               <= round_even(0.1 * (SELECT count(*) FROM eligible), 0)""",
)
_cte("test", ["scores", "held_out"], "SELECT * FROM scores SEMI JOIN held_out USING (user_id)")
_cte("train", ["scores", "held_out"], "SELECT * FROM scores ANTI JOIN held_out USING (user_id)")
for _n in ("test", "train"):
    ORACLES[f"holdout_{_n}"] = _with(
        [_n], f"SELECT user_id, product_id, {r6('score')} AS score FROM {_n}"
    )
_baselines("train", "train")
_cte(
    "test_top",
    ["test", "train_mu", "train_items"],
    """SELECT user_id, product_id, mu + coalesce(b_i, 0) AS raw,
         row_number() OVER (PARTITION BY user_id
           ORDER BY round(mu + coalesce(b_i, 0), 6) DESC, product_id) AS rank
       FROM test LEFT JOIN train_items USING (product_id), train_mu QUALIFY rank <= 3""",
)
ORACLES["eval_topn"] = _with(
    ["test_top"], f"SELECT user_id, product_id, rank, {r6('raw')} AS est FROM test_top"
)


def _f1(lists: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
    SELECT *, CASE WHEN precision + recall = 0 THEN 0
                   ELSE 2 * precision * recall / (precision + recall) END AS f1
    FROM (SELECT {g} hits, recommended, actual, hits / recommended AS precision,
                 hits / actual AS recall
          FROM (SELECT {g} CAST(sum(h) AS BIGINT) AS hits, CAST(sum(r) AS BIGINT) AS recommended,
                       CAST(sum(a) AS BIGINT) AS actual
                FROM (SELECT {g} user_id, count(*) AS r, count(t.user_id) AS h,
                             (SELECT count(*) FROM truth x WHERE x.user_id = l.user_id) AS a
                      FROM {lists} l LEFT JOIN truth t USING (user_id, product_id)
                      GROUP BY ALL) {by}))"""


ORACLES["eval_f1"] = _with(
    ["test_top", "truth"],
    f"""SELECT hits, recommended, actual, {r6('precision')} AS precision, {r6('recall')} AS recall,
        {r6('f1')} AS f1 FROM ({_f1('test_top')})""",
)
_cte(
    "half",
    ["truth"],
    """SELECT * FROM truth
       QUALIFY row_number() OVER (ORDER BY md5(concat('123:', user_id, ':', product_id)))
               <= round_even(0.5 * (SELECT count(*) FROM truth), 0)""",
)
ORACLES["eval_user_precision"] = _with(
    ["half", "truth", "all_est"],
    f"""SELECT user_id, {r6('h / least(a, 3)')} AS precision FROM (
          SELECT user_id, count(*) AS h, (SELECT count(*) FROM truth t WHERE t.user_id = l.user_id) AS a
          FROM (SELECT user_id, product_id FROM half JOIN all_est USING (user_id, product_id)
                QUALIFY row_number() OVER (PARTITION BY user_id
                  ORDER BY round(raw, 6) DESC, product_id) <= 3) l GROUP BY user_id)""",
)
_cte(
    "trials",
    [],
    """
    SELECT CAST(row_number() OVER (ORDER BY a.i, b.i, c.i, d.i) - 1 AS INTEGER) AS weight_id,
           0.6 + 0.3 * a.i / 3 AS w3, 0.2 + 0.8 * b.i / 3 AS r2, 0.1 + 0.9 * c.i / 3 AS r4,
           0.1 + 0.9 * d.i / 3 AS r1
    FROM range(1, 3) a(i), range(1, 3) b(i), range(1, 3) c(i), range(1, 3) d(i)
    """,
)
_cte(
    "weights",
    ["trials"],
    """SELECT weight_id, w3 * r2 * r4 * r1 AS w1, w3 * r2 AS w2, w3, w3 * r2 * r4 AS w4,
         r2, r4, r1 FROM trials""",
)
ORACLES["scalar_ratio_weights"] = _with(
    ["catalog"],
    f"""SELECT product_id, {r6('w3 * r2 * r4 * r1')} AS w1, {r6('w3 * r2')} AS w2, {r6('w3')} AS w3,
        {r6('w3 * r2 * r4')} AS w4,
        w3 * r2 * r4 * r1 < w3 * r2 * r4 AND w3 * r2 * r4 < w3 * r2 AND w3 * r2 < w3 AS valid
        FROM (SELECT CAST(p_partkey AS VARCHAR) AS product_id, 0.6 + 0.3 * p_size / 50 AS w3,
              0.2 + 0.8 * p_size / 50 AS r2, 0.1 + 0.9 * len(p_name) / 20 AS r4,
              0.1 + 0.9 * len(p_type) / 8 AS r1 FROM part)""",
)
_cte(
    "sweep_train",
    ["features", "weights", "held_out"],
    """SELECT weight_id, user_id, product_id, sum(w1*F1 + w2*F2 + w3*F3 + w4*F4) AS score
       FROM (SELECT * FROM features ANTI JOIN held_out USING (user_id)) f, weights GROUP BY ALL""",
)
_baselines("sweep", "sweep_train", group="weight_id")
_cte(
    "sweep_top",
    ["test", "sweep_mu", "sweep_items"],
    """SELECT weight_id, user_id, product_id FROM (SELECT user_id, product_id, weight_id, mu FROM test, sweep_mu)
       LEFT JOIN sweep_items USING (weight_id, product_id)
       QUALIFY row_number() OVER (PARTITION BY weight_id, user_id
         ORDER BY round(mu + coalesce(b_i, 0), 6) DESC, product_id) <= 3""",
)
ORACLES["weight_sweep"] = _with(
    ["sweep_top", "truth", "weights"],
    f"""SELECT weight_id, {r6('w1')} AS w1, {r6('w2')} AS w2, {r6('w3')} AS w3, {r6('w4')} AS w4,
        hits, recommended, actual, {r6('f1')} AS f1
        FROM weights JOIN ({_f1('sweep_top', 'weight_id')}) USING (weight_id)""",
)

# ---- text, neighbours, vectors ------------------------------------------------------------
_cte(
    "texts",
    ["catalog"],
    """
    SELECT product_id, concat_ws(' ', coalesce(name, 'nan'), product_id, coalesce(category, 'nan'),
      coalesce(brand, 'nan'), coalesce(CAST(price AS VARCHAR), 'nan'), coalesce(description, ''),
      coalesce(type, '')) AS text FROM catalog
    """,
)
ORACLES["concat_features"] = _with(["texts"], "SELECT * FROM texts")


def _tfidf(prefix: str, docs: str, doc: str) -> None:
    _cte(
        f"{prefix}_tf",
        [docs],
        rf"""SELECT {doc}, term, count(*) AS tf FROM (SELECT {doc}, unnest(regexp_extract_all(
             lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {docs}) GROUP BY ALL""",
    )
    _cte(
        f"{prefix}_vocab",
        [f"{prefix}_tf", docs],
        f"""SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
            FROM {prefix}_tf, (SELECT count(*) AS n FROM {docs}) GROUP BY term
            HAVING count(*) >= 5 AND count(*) <= 0.8 * any_value(n)
            ORDER BY sum(tf) DESC, term LIMIT 5000""",
    )
    _cte(
        f"{prefix}_weights",
        [f"{prefix}_tf", f"{prefix}_vocab"],
        f"""SELECT {doc}, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {doc}))
              AS weight FROM {prefix}_tf JOIN {prefix}_vocab USING (term)""",
    )


_tfidf("cat", "texts", "product_id")
_cte("docs", [], "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
_tfidf("doc", "docs", "doc_id")
ORACLES["tfidf_weights"] = _with(
    ["cat_weights"], f"SELECT product_id, term, tf, {r6('weight')} AS weight FROM cat_weights"
)
ORACLES["tfidf_documents"] = _with(
    ["doc_weights"], f"SELECT doc_id, term, tf, {r6('weight')} AS weight FROM doc_weights"
)
_cte(
    "neighbors",
    ["cat_weights", "catalog"],
    """
    SELECT product_id, rank, rec_product_id, similarity FROM (
      SELECT a.product_id, b.product_id AS rec_product_id, coalesce(s.similarity, 0) AS similarity,
        row_number() OVER (PARTITION BY a.product_id
          ORDER BY coalesce(s.similarity, 0) DESC, b.product_id) AS rank
      FROM catalog a JOIN catalog b ON a.product_id <> b.product_id
      LEFT JOIN (SELECT x.product_id AS p, y.product_id AS q,
                        round(sum(x.weight * y.weight), 6) AS similarity
                 FROM cat_weights x JOIN cat_weights y USING (term) GROUP BY ALL) s
        ON s.p = a.product_id AND s.q = b.product_id)
    WHERE rank <= 10
    """,
)
ORACLES["content_neighbors"] = _with(
    ["neighbors"],
    f"SELECT product_id, rank, rec_product_id, {r6('similarity')} AS similarity FROM neighbors",
)
ORACLES["content_recommend"] = _with(
    ["neighbors"],
    f"""SELECT r.product_id, rank, rec_product_id, {r6('similarity')} AS similarity,
        rec_product_id IS NOT NULL AS found
        FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS product_id FROM orders) r
        LEFT JOIN neighbors n USING (product_id)""",
)
_cte(
    "details",
    [],
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name,
         concat(CASE WHEN p_size <= 25 THEN 'electronics ' ELSE 'home ' END, lower(p_type))
           AS category_code, p_brand AS brand FROM part""",
)
ORACLES["same_category_brand"] = _with(
    ["details"],
    """SELECT a.product_id AS target, b.product_id AS candidate,
         row_number() OVER (PARTITION BY a.product_id ORDER BY b.product_id) AS rank
       FROM details a JOIN details b USING (category_code, brand)
       WHERE a.product_id <> b.product_id QUALIFY rank <= 10""",
)


def _names(prefix: str, wanted: str) -> None:
    """Closest names for ``wanted`` (target, excluded list, needed)."""
    _cte(
        f"{prefix}_corpus",
        [wanted, "details"],
        f"""SELECT w.target, w.needed, d.product_id, d.name FROM {wanted} w
            JOIN details t ON t.product_id = w.target
            JOIN details d ON d.category_code = t.category_code AND d.brand = t.brand
             AND (d.product_id = w.target OR NOT list_contains(w.excluded, d.product_id))
            WHERE w.needed > 0""",
    )
    _cte(
        f"{prefix}_terms",
        [f"{prefix}_corpus"],
        rf"""SELECT target, product_id, term, count(*) AS tf FROM (SELECT target, product_id,
             unnest(regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
             FROM {prefix}_corpus) GROUP BY ALL""",
    )
    _cte(
        f"{prefix}_w",
        [f"{prefix}_terms", f"{prefix}_corpus"],
        f"""SELECT target, product_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY target,
              product_id)) AS w FROM (
              SELECT t.target, t.product_id, t.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w
              FROM {prefix}_terms t
              JOIN (SELECT target, term, count(*) AS df FROM {prefix}_terms GROUP BY ALL) d
                USING (target, term)
              JOIN (SELECT target, count(*) AS n FROM {prefix}_corpus GROUP BY ALL) USING (target))""",
    )
    _cte(
        f"{prefix}_similar",
        [f"{prefix}_w", f"{prefix}_corpus"],
        f"""SELECT * FROM (
            SELECT c.target, c.product_id, c.needed, coalesce(s.similarity, 0) AS similarity,
              row_number() OVER (PARTITION BY c.target
                ORDER BY coalesce(s.similarity, 0) DESC, c.product_id) AS rank
            FROM {prefix}_corpus c LEFT JOIN (
              SELECT a.target, b.product_id, round(sum(a.w * b.w), 6) AS similarity
              FROM {prefix}_w a JOIN {prefix}_w b USING (target, term)
              WHERE a.product_id = a.target GROUP BY ALL) s USING (target, product_id)
            WHERE c.product_id <> c.target) WHERE rank <= needed""",
    )


_cte(
    "every_target",
    ["details"],
    """SELECT product_id AS target, CAST([] AS VARCHAR[]) AS excluded, 10 AS needed FROM details""",
)
_names("near", "every_target")
ORACLES["name_similarity"] = _with(
    ["near_similar"], f"SELECT target, rank, product_id, {r6('similarity')} AS similarity FROM near_similar"
)
ORACLES["vector_lookup"] = f"""
    SELECT label, point_id, len(embedding) AS dims, {r6('embedding[1]')} AS head,
      {r6('embedding[len(embedding)]')} AS tail
    FROM (SELECT CAST(vec_id AS VARCHAR) AS point_id, label, embedding FROM embeddings
          QUALIFY row_number() OVER (PARTITION BY label ORDER BY CAST(vec_id AS VARCHAR)) = 1)"""
ORACLES["vector_truncate"] = f"""
    SELECT CAST(vec_id AS VARCHAR) AS point_id, len(embedding[1:32]) AS dims,
      {r6('list_sum(CAST(embedding[1:32] AS DOUBLE[]))')} AS total
    FROM embeddings WHERE len(embedding) >= 32"""
_cte(
    "unit",
    [],
    """SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
       FROM embeddings""",
)
ORACLES["vector_topk"] = _with(
    ["unit"],
    f"""SELECT id, neighbor, {r6('similarity')} AS similarity, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor) AS rank
          FROM (SELECT a.id, b.id AS neighbor,
                  round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS similarity
                FROM unit a, unit b)) WHERE rank <= 10""",
)
ORACLES["vector_search"] = _with(
    ["unit"],
    f"""SELECT id, rank, neighbor AS point_id, {r6('similarity')} AS similarity, label,
          {r6('list_sum(CAST(embedding AS DOUBLE[]))')} AS total FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor) AS rank
          FROM (SELECT a.id, b.id AS neighbor,
                  round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS similarity
                FROM unit a, unit b)) JOIN embeddings ON CAST(vec_id AS VARCHAR) = neighbor
        WHERE rank <= 10""",
)
ORACLES["dedupe_points"] = _with(
    ["clean"],
    """SELECT user_session AS point_id, event_id, event_type, product_id,
         CASE WHEN event_type = 'purchase' THEN price END AS price
       FROM clean QUALIFY row_number() OVER (PARTITION BY user_session
                                             ORDER BY event_time, event_id) = 1""",
)
ORACLES["upsert_latest"] = _with(
    ["clean"],
    """SELECT product_id, event_id AS version, event_type,
         CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE price END AS price
       FROM clean QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY event_id DESC) = 1""",
)

# ---- recommendations ----------------------------------------------------------------------
_cte(
    "last_touch",
    ["behaviors"],
    """SELECT user_id, max_by(product_id, (event_time, event_id)) AS product_id FROM behaviors
       GROUP BY user_id""",
)
_cte(
    "target_span",
    ["clean", "last_touch"],
    """SELECT product_id AS target, max(event_time) AS last_time,
         max(event_time) - INTERVAL 3 MONTH AS cutoff FROM clean
       WHERE product_id IN (SELECT product_id FROM last_touch) GROUP BY 1""",
)
_cte(
    "candidates",
    ["clean", "target_span"],
    """
    SELECT s.target, c.product_id, count(*) AS appearance_count
    FROM (SELECT DISTINCT target, user_session, cutoff, last_time FROM target_span
          JOIN clean ON product_id = target AND event_time >= cutoff) s
    JOIN clean c ON c.user_session = s.user_session AND c.event_time >= s.cutoff
      AND c.event_time <= s.last_time AND c.product_id <> s.target
    GROUP BY ALL
    """,
)
ORACLES["session_candidates"] = _with(["candidates"], "SELECT * FROM candidates")
_cte(
    "cand_ranked",
    ["candidates", "all_items"],
    """
    SELECT *, CASE WHEN appearance_count >= 3 AND row_number() OVER (PARTITION BY target,
        appearance_count >= 3 ORDER BY appearance_count DESC, b DESC, product_id) <= 3
        THEN appearance_count END AS top_count
    FROM (SELECT *, round(coalesce(b_i, 0), 6) AS b FROM candidates LEFT JOIN all_items USING (product_id))
    """,
)
_cte(
    "session_tiers",
    ["cand_ranked", "target_span", "clean", "all_items"],
    """
    SELECT target, product_id, appearance_count, b, CASE WHEN top_count IS NULL THEN 1 ELSE 0 END AS tier,
           top_count FROM cand_ranked
    UNION ALL
    SELECT target, p.product_id, NULL, p.b, 2, NULL FROM target_span,
      (SELECT product_id, round(coalesce(b_i, 0), 6) AS b FROM (SELECT DISTINCT product_id FROM clean)
       LEFT JOIN all_items USING (product_id)) p
    WHERE p.product_id <> target
      AND NOT EXISTS (SELECT 1 FROM cand_ranked x WHERE x.target = target_span.target
                      AND x.product_id = p.product_id)
    """,
)
_cte(
    "session_top",
    ["session_tiers"],
    """SELECT *, row_number() OVER (PARTITION BY target
         ORDER BY tier, top_count DESC NULLS LAST, b DESC, product_id) AS rank
       FROM session_tiers QUALIFY rank <= 10""",
)
_cte(
    "event_details",
    ["clean"],
    """SELECT product_id, name, category_code, brand FROM clean
       QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY event_time, event_id) = 1""",
)
ORACLES["session_recommend"] = _with(
    ["session_top", "last_touch", "all_users", "all_items", "all_mu", "event_details"],
    f"""
    SELECT l.user_id, t.target, t.rank, t.product_id, t.appearance_count,
      {r6('least(greatest(mu + b_u + coalesce(b_i, 0), lo), hi)')} AS predicted_score,
      name, category_code, brand
    FROM last_touch l JOIN all_users USING (user_id) JOIN session_top t ON t.target = l.product_id
    LEFT JOIN all_items i ON i.product_id = t.product_id
    LEFT JOIN event_details d ON d.product_id = t.product_id, all_mu
    """,
)
_FACTOR = "(CAST(concat('0x', substr(md5(concat('{l}{j}:', {key})), 1, 6)) AS BIGINT) % 17 - 8) / 64.0"
_DOT = " + ".join(
    f"CAST({_FACTOR.format(l='u', j=j, key='user_id')} AS DOUBLE) * CAST({_FACTOR.format(l='i', j=j, key='product_id')} AS DOUBLE)"
    for j in range(4)
)
_cte(
    "personal_value",
    ["last_touch", "all_users", "all_items", "clean"],
    f"""SELECT user_id, l.target, p.product_id, b_u, coalesce(b_i, 0) AS b_i,
          CASE WHEN b_i IS NULL THEN 0 ELSE {_DOT} END AS d,
          round(coalesce(b_i, 0) + CASE WHEN b_i IS NULL THEN 0 ELSE {_DOT} END, 6) AS v
        FROM (SELECT user_id, product_id AS target FROM last_touch
              WHERE product_id IN (SELECT product_id FROM clean)) l JOIN all_users USING (user_id),
          (SELECT DISTINCT product_id FROM clean) p LEFT JOIN all_items USING (product_id)
        WHERE p.product_id <> l.target""",
)
_cte(
    "personal_tiers",
    ["personal_value", "candidates"],
    """SELECT *, CASE WHEN appearance_count IS NULL THEN 2 WHEN nth <= 3 THEN 0 ELSE 1 END AS tier FROM (
         SELECT *, CASE WHEN appearance_count >= 3 THEN row_number() OVER (
             PARTITION BY user_id, target, coalesce(appearance_count, 0) >= 3
             ORDER BY appearance_count DESC, v DESC, product_id) ELSE 99 END AS nth
         FROM personal_value LEFT JOIN candidates USING (target, product_id))""",
)
ORACLES["personal_recommend"] = _with(
    ["personal_tiers", "all_mu", "event_details"],
    f"""
    SELECT user_id, target, rank, product_id, appearance_count,
      {r6('least(greatest(mu + b_u + b_i + d, lo), hi)')} AS predicted_score, name, category_code, brand
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY tier,
            CASE WHEN tier = 0 THEN nth END, v DESC, product_id) AS rank
          FROM personal_tiers QUALIFY rank <= 10)
    LEFT JOIN event_details USING (product_id), all_mu
    """,
)


def _cold(prefix: str, clusters: str, others_first: bool, final_cut: bool) -> None:
    _cte(
        f"{prefix}_of",
        [clusters, "catalog"],
        f"""SELECT product_id AS target, coalesce(
              (SELECT min(target) FROM {clusters} c WHERE c.target = k.product_id),
              (SELECT min(target) FROM {clusters} c WHERE c.candidate = k.product_id)) AS cluster
            FROM catalog k""",
    )
    _cte(
        f"{prefix}_members",
        [f"{prefix}_of", clusters],
        f"""SELECT o.target, c.bucket, c.rank, c.candidate FROM {prefix}_of o
            JOIN {clusters} c ON c.target = o.cluster
            WHERE c.candidate IS NOT NULL AND c.candidate <> o.target""",
    )
    _cte(
        f"{prefix}_lists",
        [f"{prefix}_members"],
        f"""SELECT target, bucket, rank, candidate FROM {prefix}_members
            WHERE bucket = 'top' AND rank <= 8
            UNION ALL
            SELECT target, bucket, rank, candidate FROM {prefix}_members WHERE bucket = 'others'
            QUALIFY row_number() OVER (PARTITION BY target
              ORDER BY md5(concat('42:', target, ':', candidate))) <= 2""",
    )
    _cte(
        f"{prefix}_wanted",
        [f"{prefix}_lists", "catalog"],
        f"""SELECT product_id AS target, coalesce(x, CAST([] AS VARCHAR[])) AS excluded,
              greatest(10 - coalesce(len(x), 0), 0) AS needed FROM catalog LEFT JOIN
              (SELECT target AS product_id, list(candidate) AS x FROM {prefix}_lists GROUP BY 1)
              USING (product_id)""",
    )
    _names(prefix, f"{prefix}_wanted")
    top, others = (1, 0) if others_first else (0, 1)
    limit = "WHERE rank <= 10" if final_cut else ""
    _cte(
        f"{prefix}_answer",
        [f"{prefix}_lists", f"{prefix}_similar"],
        f"""SELECT * FROM (SELECT target, source, product_id, row_number() OVER (
              PARTITION BY target ORDER BY tier, pos) AS rank FROM (
            SELECT target, bucket AS source, candidate AS product_id, rank AS pos,
                   CASE WHEN bucket = 'top' THEN {top} ELSE {others} END AS tier FROM {prefix}_lists
            UNION ALL SELECT target, 'similar', product_id, rank, 2 FROM {prefix}_similar)) {limit}""",
    )
    ORACLES[prefix] = _with(
        [f"{prefix}_answer", "details"],
        f"""SELECT target, source, rank, product_id, name, category_code, brand
            FROM {prefix}_answer LEFT JOIN details USING (product_id)""",
    )


_cold("coldstart_recommend", "clusters_8_5", False, True)
_cold("anonymous_recommend", "clusters_5_2", True, False)

# ---- rating predictors --------------------------------------------------------------------
_cte(
    "rated_test",
    ["scores"],
    """SELECT * FROM scores
       QUALIFY row_number() OVER (ORDER BY md5(concat('7:', user_id, ':', product_id)))
               <= round_even(0.2 * (SELECT count(*) FROM scores), 0)""",
)
_cte(
    "rated",
    ["scores", "rated_test"],
    "SELECT * FROM scores ANTI JOIN rated_test USING (user_id, product_id)",
)
_baselines("rated", "rated")
_cte(
    "sims",
    ["rated"],
    """SELECT a.user_id, b.user_id AS other,
         1 / (sum((a.score - b.score) * (a.score - b.score)) / count(*) + 1) AS sim
       FROM rated a JOIN rated b USING (product_id) WHERE a.user_id <> b.user_id GROUP BY ALL""",
)
_cte(
    "near",
    ["rated_test", "rated", "sims"],
    """SELECT t.user_id, t.product_id, s.other, s.sim, r.score FROM rated_test t
       JOIN rated r ON r.product_id = t.product_id
       JOIN sims s ON s.user_id = t.user_id AND s.other = r.user_id
       QUALIFY row_number() OVER (PARTITION BY t.user_id, t.product_id
         ORDER BY round(s.sim, 6) DESC, s.other) <= 40""",
)
_cte("user_means", ["rated"], "SELECT user_id, avg(score) AS m FROM rated GROUP BY 1")
_cte(
    "known",
    ["rated_test", "user_means", "rated", "rated_mu"],
    """SELECT t.*, mu, lo, hi, CASE WHEN product_id IN (SELECT product_id FROM rated) THEN
         coalesce(m, mu) ELSE mu END AS base
       FROM rated_test t LEFT JOIN user_means USING (user_id), rated_mu""",
)


def _predicted(name: str, needs: list[str], value: str, start: str, joins: str = "") -> None:
    """Similarity-weighted mean of ``value`` over the neighbours, added to ``start``."""
    ORACLES[name] = _with(
        ["known", "near", *needs],
        f"""SELECT k.user_id, k.product_id, {r6('k.score')} AS score,
            {r6(f'least(greatest({start}, lo), hi)')} AS est
            FROM known k LEFT JOIN (SELECT n.user_id, n.product_id, sum(sim * ({value})) / sum(sim) AS e
              FROM near n {joins} GROUP BY ALL) USING (user_id, product_id)
            LEFT JOIN rated_users ru ON ru.user_id = k.user_id
            LEFT JOIN rated_items ri ON ri.product_id = k.product_id""",
    )


_both = ["rated_users", "rated_items"]
_predicted("knn_basic", _both, "n.score", "coalesce(e, mu)")
_predicted(
    "knn_means", [*_both, "user_means"], "n.score - m", "base + coalesce(e, 0)",
    "JOIN user_means um ON um.user_id = n.other",
)
_predicted(
    "knn_baseline", [*_both, "rated_mu"], "n.score - x.mu - u.b_u - i.b_i",
    "mu + coalesce(ru.b_u, 0) + coalesce(ri.b_i, 0) + coalesce(e, 0)",
    """JOIN rated_users u ON u.user_id = n.other JOIN rated_items i ON i.product_id = n.product_id,
       rated_mu x""",
)
_cte(
    "devs",
    ["rated"],
    """SELECT a.product_id, b.product_id AS rated, avg(a.score - b.score) AS dev
       FROM rated a JOIN rated b USING (user_id) WHERE a.product_id <> b.product_id GROUP BY ALL""",
)
ORACLES["slope_one"] = _with(
    ["known", "devs", "rated"],
    f"""SELECT user_id, product_id, {r6('score')} AS score,
        {r6('least(greatest(base + coalesce(d, 0), lo), hi)')} AS est
        FROM known LEFT JOIN (SELECT t.user_id, t.product_id, avg(dev) AS d FROM rated_test t
          JOIN rated r USING (user_id) JOIN devs v ON v.product_id = t.product_id
          AND v.rated = r.product_id GROUP BY ALL) USING (user_id, product_id)""",
)
# Co-clustering: the assignments of every epoch are tables of their own. All epochs are written out;
# one without any move repeats the state before it.
_CELL = "coalesce({v}, (SELECT avg(score) FROM rated))"
for _key, _name in (("user_id", "g"), ("product_id", "h")):
    _cte(
        f"co_{_name}0",
        ["rated"],
        f"""SELECT {_key}, avg(score) AS mean_{_name},
            CAST(concat('0x', substr(md5(concat('42:', {_key})), 1, 8)) AS BIGINT) % 3 AS {_name}
            FROM rated GROUP BY {_key}""",
    )


def _co_tables(e: int) -> None:
    joined = f"rated JOIN co_g{e} USING (user_id) JOIN co_h{e} USING (product_id)"
    needs = ["rated", f"co_g{e}", f"co_h{e}"]
    _cte(f"co_cell{e}", needs, f"SELECT g, h, avg(score) AS cell FROM {joined} GROUP BY g, h")
    _cte(f"co_by_g{e}", needs, f"SELECT g, avg(score) AS by_g FROM {joined} GROUP BY g")
    _cte(f"co_by_h{e}", needs, f"SELECT h, avg(score) AS by_h FROM {joined} GROUP BY h")


def _co_estimate(e: int, source: str) -> str:
    return f"""(SELECT x.*, {_CELL.format(v='cell')} + (mean_g - {_CELL.format(v='by_g')})
                  + (mean_h - {_CELL.format(v='by_h')}) AS est
                FROM {source} x LEFT JOIN co_cell{e} USING (g, h) LEFT JOIN co_by_g{e} USING (g)
                LEFT JOIN co_by_h{e} USING (h))"""


def _co_assign(e: int, key: str, name: str, users: str, items: str) -> None:
    """The cluster of least squared error for each user, or product, by the means of epoch ``e``."""
    other = "mean_g, mean_h, h" if name == "g" else "mean_g, mean_h, g"
    source = f"""(SELECT user_id, product_id, score, {other}, c AS {name}
                  FROM rated JOIN {users} USING (user_id) JOIN {items} USING (product_id), range(3) t(c))"""
    _cte(
        f"co_{name}{e + 1}",
        ["rated", users, items, f"co_cell{e}", f"co_by_g{e}", f"co_by_h{e}"],
        f"""SELECT {key}, any_value(mean_{name}) AS mean_{name}, arg_min({name}, (err, {name})) AS {name}
            FROM (SELECT {key}, any_value(mean_{name}) AS mean_{name}, {name},
                    round(sum((score - est) * (score - est)), 9) AS err
                  FROM {_co_estimate(e, source)} GROUP BY {key}, {name}) GROUP BY {key}""",
    )


_EPOCHS = 20
for _e in range(_EPOCHS):
    _co_tables(_e)
    _co_assign(_e, "user_id", "g", f"co_g{_e}", f"co_h{_e}")
    _co_assign(_e, "product_id", "h", f"co_g{_e + 1}", f"co_h{_e}")
_co_tables(_EPOCHS)
ORACLES["coclustering"] = _with(
    ["rated", "rated_test", f"co_cell{_EPOCHS}", f"co_by_g{_EPOCHS}", f"co_by_h{_EPOCHS}"],
    f"""SELECT user_id, product_id, {r6('score')} AS score, {r6('least(greatest(est, lo), hi)')} AS est
        FROM (SELECT user_id, product_id, score, CASE WHEN g IS NOT NULL AND h IS NOT NULL THEN est
                ELSE coalesce(mean_g, mean_h, (SELECT avg(score) FROM rated)) END AS est
              FROM {_co_estimate(_EPOCHS, f"(SELECT * FROM rated_test LEFT JOIN co_g{_EPOCHS} USING (user_id) LEFT JOIN co_h{_EPOCHS} USING (product_id))")}),
        (SELECT min(score) AS lo, max(score) AS hi FROM rated)""",
)
ORACLES["normal_predictor"] = _with(
    ["rated_test", "rated"],
    f"""SELECT user_id, product_id, {r6('score')} AS score,
        {r6('least(greatest(m + s * sqrt(-2 * ln(u)) * cos(2 * pi() * v), lo), hi)')} AS est
        FROM (SELECT *, (CAST('0x' || substr(h, 1, 8) AS BIGINT) + 1) / (4294967297.0::DOUBLE) AS u,
                (CAST('0x' || substr(h, 9, 8) AS BIGINT) + 1) / (4294967297.0::DOUBLE) AS v
              FROM (SELECT *, md5(concat('42:', user_id, ':', product_id)) AS h FROM rated_test)),
        (SELECT avg(score) AS m, stddev_pop(score) AS s, min(score) AS lo, max(score) AS hi
         FROM rated)""",
)

ORACLES["model_compare_fixed"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS model, round(sqrt(avg((score - est) * (score - est))), 4) AS rmse,
          round(avg(abs(score - est)), 4) AS mae FROM ({ORACLES[query]})"""
    for name, query in (
        ("knnbasic", "knn_basic"),
        ("knnwithmeans", "knn_means"),
        ("knnbaseline", "knn_baseline"),
        ("normalpredictor", "normal_predictor"),
        ("slopeone", "slope_one"),
    )
)
_cte(
    "hashed",
    ["catalog"],
    r"""SELECT product_id AS point_id, name, price,
          CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % 128 AS bucket, count(*) AS tf
        FROM (SELECT *, unnest(regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''),
                coalesce(category, ''), coalesce(type, ''), coalesce(description, ''))),
                '[\p{L}\p{N}_]{2,}')) AS term FROM catalog) GROUP BY ALL""",
)
ORACLES["hashed_vectors"] = _with(
    ["hashed"],
    f"""SELECT point_id, name, price, bucket,
          {r6('CAST(tf / sqrt(sum(tf * tf) OVER (PARTITION BY point_id)) AS FLOAT)')} AS weight
        FROM hashed""",
)

# ---- streams, in their batch form ---------------------------------------------------------
_cte(
    "records",
    [],
    """
    SELECT event_id AS "offset", CASE WHEN event_type = 'error' THEN NULL
      WHEN event_type = 'signup' THEN '{bad'
      ELSE concat('{"event_time":"', strftime(ts, '%Y-%m-%d %H:%M:%S'), ' UTC","event_type":"',
                  event_type, '"}') END AS message FROM events
    """,
)
ORACLES["stream_filter"] = _with(
    ["records"],
    """
    SELECT "offset", message, epoch_us(t) AS event_us FROM (
      SELECT *, try_strptime(CASE WHEN json_valid(message) THEN
        json_extract_string(message, '$.event_time') END, '%Y-%m-%d %H:%M:%S UTC') AS t
      FROM records WHERE message IS NOT NULL)
    WHERE t IS NULL OR (epoch_us((SELECT max(ts) FROM events)) - epoch_us(t)) / 1e6 <= 3600
    """,
)
