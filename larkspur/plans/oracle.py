"""DuckDB SQL of the queries, put together from named common table expressions.

``_CTES`` has each relation once, in an order in which each only uses earlier
ones; a query takes those it needs, and the clock that bounds it.
"""

from __future__ import annotations

import re

from larkspur.functions.words import RULES, STOP


def _r(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {n}) AS DOUBLE)"


def _pct(a: str, b: str, n: int = 2) -> str:
    return _r(f"CAST({a} AS DOUBLE) * 100.0::DOUBLE / nullif(CAST({b} AS DOUBLE), 0)", n)


def _mm(x: str, part: str, flat: int = 0) -> str:
    return f"coalesce(({x} - min({x}) OVER {part}) / nullif(max({x}) OVER {part} - min({x}) OVER {part}, 0), {flat})"


_W = "CASE interaction_type WHEN 'view' THEN 1 WHEN 'wishlist' THEN 3 WHEN 'cart' THEN 5 WHEN 'purchase' THEN 10 ELSE 0 END"
_AGE = "CAST(epoch_us((SELECT as_of FROM clock)) - epoch_us({t}) AS DOUBLE) / 86400000000.0::DOUBLE"


def _decay(t: str, half: int) -> str:
    return f"pow(0.5::DOUBLE, greatest({_AGE.format(t=t)}, 0) / {half}.0::DOUBLE)"


def _stems(field: str) -> str:
    cut = "t"
    for old, new in RULES:
        cut = f"""regexp_replace({cut}, '{old}', '{new.replace("$", chr(92))}', 'g')"""
    stop = ", ".join(f"'{w}'" for w in STOP)
    words = f"list_filter(string_split_regex(lower({field}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({stop}))"
    return f"list_transform({words}, lambda t: CASE WHEN length(t) <= 2 THEN t ELSE {cut} END)"


_KINDS = ", ".join(f"count(*) FILTER (interaction_type = '{k}') AS {k}_count" for k in ("view", "wishlist", "cart", "purchase"))

_CTES: dict[str, str] = {
    "interactions": """SELECT event_id AS interaction_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
        CASE event_type WHEN 'signup' THEN 'wishlist' WHEN 'click' THEN 'cart' ELSE event_type END AS interaction_type, ts AS interaction_timestamp
      FROM events WHERE event_type <> 'error'""",
    "ords": "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount FROM orders",
    "items": """SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue
      FROM lineitem GROUP BY ALL""",
    "stars": """SELECT o_custkey AS user_id, l_partkey AS product_id, 1 + CAST(round(l_tax * 100) AS INTEGER) % 5 AS rating, o_orderdate AS created_at
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      QUALIFY row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "products": """SELECT p_partkey AS product_id, p_name AS name, CAST(dense_rank() OVER (ORDER BY p_type) AS INTEGER) AS category_id, p_type AS category_name,
        'size_' || CAST((p_size - 1) // 10 AS VARCHAR) AS subcategory, p_brand AS brand, concat_ws(' ', p_name, p_brand, p_type) AS description,
        CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price, p_size > 2 AS is_active FROM part""",
    "users": """SELECT c_custkey AS user_id, n_name AS city, c_mktsegment AS persona, coalesce(CAST(f.d AS DATE), DATE '1995-01-01') AS signup_date
      FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey""",
    "log": "SELECT * FROM interactions WHERE interaction_timestamp < (SELECT as_of FROM clock)",
    "past": "SELECT * FROM ords WHERE order_date < (SELECT as_of FROM clock)",
    "lines": "SELECT i.*, o.user_id, o.order_date, p.name, p.category_id, p.category_name, p.brand, p.price FROM items i JOIN past o USING (order_id) JOIN products p USING (product_id)",
    "upf": f"""SELECT user_id, product_id, {_KINDS}, count(*) AS interaction_count, min(interaction_timestamp) AS first_interaction, max(interaction_timestamp) AS last_interaction,
        CAST(floor({_AGE.format(t="max(interaction_timestamp)")}) AS INTEGER) AS days_since_interaction, CAST(sum({_W}) AS BIGINT) AS interaction_score,
        {_r(f"sum(({_W}) * {_decay('interaction_timestamp', 60)})", 4)} AS decayed_score, bool_or(interaction_type = 'purchase') AS has_purchased
      FROM log GROUP BY user_id, product_id""",
    "ucp": f"""SELECT user_id, category_id, category_name, interaction_score, CAST(ds AS DOUBLE) AS decayed_score, purchase_count, distinct_products, last_interaction,
        {_r("CAST(ds AS DOUBLE) / nullif(CAST(sum(ds) OVER (PARTITION BY user_id) AS DOUBLE), 0)", 4)} AS category_affinity,
        row_number() OVER (PARTITION BY user_id ORDER BY ds DESC, category_id) AS preference_rank, rank() OVER (PARTITION BY user_id ORDER BY ds DESC) AS preference_rank_with_ties,
        dense_rank() OVER (PARTITION BY user_id ORDER BY ds DESC) AS preference_tier, {_r("percent_rank() OVER (PARTITION BY user_id ORDER BY ds)", 4)} AS affinity_percentile
      FROM (SELECT user_id, category_id, category_name, CAST(sum(interaction_score) AS BIGINT) AS interaction_score, sum(CAST(decayed_score AS DECIMAL(18,4))) AS ds,
        CAST(sum(purchase_count) AS BIGINT) AS purchase_count, count(*) AS distinct_products, max(last_interaction) AS last_interaction FROM upf JOIN products USING (product_id) GROUP BY 1, 2, 3)""",
    "rated": f"SELECT product_id, {_r('avg(rating)', 3)} AS avg_rating, count(*) AS rating_count FROM stars WHERE created_at < (SELECT as_of FROM clock) GROUP BY 1",
    "prior": "SELECT coalesce(CAST(sum(CAST(avg_rating AS DECIMAL(18,3))) AS DOUBLE) / nullif(count(avg_rating), 0), 3.5) AS gm, greatest(coalesce(quantile_cont(rating_count, 0.5), 10), 5)::DOUBLE AS pv FROM rated",
    "pop": f"""SELECT *, {_r("percent_rank() OVER (ORDER BY decayed_engagement)", 4)} AS popularity_score, row_number() OVER (ORDER BY decayed_engagement DESC, product_id) AS popularity_global_rank,
        rank() OVER (PARTITION BY category_id ORDER BY decayed_engagement DESC) AS popularity_category_rank,
        ['head', 'upper_torso', 'lower_torso', 'long_tail'][ntile(4) OVER (ORDER BY decayed_engagement DESC, product_id)] AS demand_tier
      FROM (SELECT p.product_id, p.name AS product_name, category_id, category_name, subcategory, brand, price, is_active,
        {", ".join(f"coalesce({k}, 0)::BIGINT AS {k}" for k in ("view_count", "wishlist_count", "cart_count", "purchase_count", "unique_users", "raw_engagement"))},
        {_r("coalesce(decayed, 0)", 4)} AS decayed_engagement, last_interaction, coalesce(rating_count, 0)::BIGINT AS rating_count, avg_rating,
        {_r("(coalesce(rating_count, 0) * coalesce(avg_rating, gm) + pv * gm) / (coalesce(rating_count, 0) + pv)", 4)} AS smoothed_rating,
        {_r("CAST(coalesce(purchase_count, 0) AS DOUBLE) / nullif(view_count, 0)", 4)} AS view_to_purchase_rate,
        CAST(floor({_AGE.format(t="last_interaction")}) AS INTEGER) AS days_since_last_interaction,
        CASE WHEN last_interaction IS NULL THEN 1.0 ELSE {_r(_decay("last_interaction", 30), 4)} END AS recency_score
        FROM products p LEFT JOIN (SELECT product_id, {_KINDS}, count(DISTINCT user_id) AS unique_users, sum({_W}) AS raw_engagement,
          sum(({_W}) * {_decay("interaction_timestamp", 30)}) AS decayed, max(interaction_timestamp) AS last_interaction FROM log GROUP BY 1) e USING (product_id)
        LEFT JOIN rated USING (product_id) CROSS JOIN prior)""",
    "trend": f"""SELECT product_id, CAST(wk AS TIMESTAMP) AS latest_week, e AS latest_week_engagement, pe AS previous_week_engagement, {_r("av", 4)} AS trailing_4week_average, ce AS cumulative_engagement,
        least({_r("e / nullif(av, 0)", 4)}, 5.0) AS momentum, CASE WHEN pe IS NULL THEN 'new' WHEN e > pe * 1.25 THEN 'rising' WHEN e < pe * 0.75 THEN 'falling' ELSE 'steady' END AS trend_direction
      FROM (SELECT product_id, wk, e, lag(e) OVER w AS pe, avg(e) OVER (PARTITION BY product_id ORDER BY wk ROWS 3 PRECEDING) AS av,
        CAST(sum(e) OVER (PARTITION BY product_id ORDER BY wk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ce, lead(wk) OVER w AS nxt
        FROM (SELECT product_id, date_trunc('week', interaction_timestamp) AS wk, CAST(sum({_W}) AS BIGINT) AS e FROM log
          WHERE interaction_timestamp >= (SELECT as_of FROM clock) - INTERVAL 112 DAY GROUP BY 1, 2) WINDOW w AS (PARTITION BY product_id ORDER BY wk)) WHERE nxt IS NULL""",
    "capped": "SELECT user_id, product_id, ln(1 + decayed_score) AS weight FROM upf WHERE decayed_score > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ln(1 + decayed_score) DESC, product_id) <= 50",
    "norms": "SELECT product_id, sqrt(sum(weight * weight)) AS norm, count(*) AS audience FROM capped GROUP BY 1",
    "pairs": f"""SELECT x.product_id AS product_a, y.product_id AS product_b, count(*) AS common_users, {_r("sum(x.weight * y.weight) / nullif(any_value(na.norm) * any_value(nb.norm), 0)", 6)} AS cosine_similarity,
        {_r("CAST(count(*) AS DOUBLE) / nullif(any_value(na.audience) + any_value(nb.audience) - count(*), 0)", 6)} AS jaccard_similarity
      FROM capped x JOIN capped y ON x.user_id = y.user_id AND x.product_id < y.product_id JOIN norms na ON na.product_id = x.product_id JOIN norms nb ON nb.product_id = y.product_id
      GROUP BY 1, 2 HAVING count(*) >= 3""",
    "sim": """SELECT m.*, cosine_similarity AS similarity_score, row_number() OVER (PARTITION BY product_a ORDER BY cosine_similarity DESC, product_b) AS neighbour_rank,
        pa.subcategory = pb.subcategory AS same_subcategory, pa.category_id = pb.category_id AS same_category
      FROM (SELECT * FROM pairs UNION ALL SELECT product_b, product_a, common_users, cosine_similarity, jaccard_similarity FROM pairs) m
      JOIN products pa ON pa.product_id = product_a JOIN products pb ON pb.product_id = product_b QUALIFY neighbour_rank <= 50""",
    "profile": """SELECT u.user_id, u.signup_date, coalesce(dp, 0)::BIGINT AS distinct_products, coalesce(ti, 0)::BIGINT AS total_interactions, coalesce(pp, 0)::BIGINT AS purchased_products, la AS last_activity,
        coalesce(dc, 0)::BIGINT AS distinct_categories, CASE WHEN coalesce(dp, 0) < 3 THEN 'cold' WHEN dp < 10 THEN 'light' ELSE 'warm' END AS user_tier
      FROM users u LEFT JOIN (SELECT user_id, count(*) AS dp, sum(interaction_count) AS ti, count(*) FILTER (has_purchased) AS pp, max(last_interaction) AS la FROM upf GROUP BY 1) USING (user_id)
      LEFT JOIN (SELECT user_id, count(*) AS dc FROM ucp GROUP BY 1) USING (user_id)""",
    "hot": f"""SELECT p.product_id, product_name, category_name AS category, price, {_r("popularity_score * coalesce(momentum, 1.0::DOUBLE) * (smoothed_rating / 5.0::DOUBLE)", 6)} AS trending_score,
        coalesce(trend_direction, 'steady') AS trend_direction FROM pop p LEFT JOIN trend USING (product_id) WHERE is_active ORDER BY trending_score DESC, product_id LIMIT 200""",
    "truth": """SELECT user_id, product_id, min(interaction_timestamp) AS first_purchase FROM interactions l
      WHERE interaction_type = 'purchase' AND interaction_timestamp >= (SELECT as_of FROM clock)
        AND NOT EXISTS (SELECT 1 FROM log b WHERE b.user_id = l.user_id AND b.product_id = l.product_id AND b.interaction_type = 'purchase') GROUP BY 1, 2""",
    "evalu": "SELECT user_id, user_tier, distinct_products, held_out_purchases FROM profile JOIN (SELECT user_id, count(*) AS held_out_purchases FROM truth GROUP BY 1) USING (user_id)",
    "served": "SELECT user_id FROM {users}",
    "cf": """SELECT user_id, product_b AS product_id, sum(similarity_score * aw) AS cf_score, count(*) AS supporting_anchors, arg_max(anchor, (similarity_score * aw, -anchor)) AS top_anchor
      FROM (SELECT user_id, product_id AS anchor, decayed_score / nullif(CAST(sum(CAST(decayed_score AS DECIMAL(18,4))) OVER (PARTITION BY user_id) AS DOUBLE), 0) AS aw
        FROM (SELECT * FROM upf WHERE decayed_score > 0 AND user_id IN (SELECT user_id FROM served) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY decayed_score DESC, product_id) <= 50))
      JOIN sim ON product_a = anchor GROUP BY 1, 2""",
    "owned": "SELECT user_id, product_id FROM upf WHERE has_purchased UNION SELECT user_id, product_id FROM items JOIN past USING (order_id)",
    "pool": """SELECT user_id, product_id, min(pr) AS priority FROM (
        SELECT user_id, product_id, 1 AS pr FROM cf
        UNION ALL SELECT user_id, p.product_id, 2 FROM ucp JOIN pop p USING (category_id) WHERE preference_rank <= 3 AND popularity_category_rank <= 25 AND is_active AND user_id IN (SELECT user_id FROM served)
        UNION ALL SELECT s.user_id, h.product_id, 3 FROM served s LEFT JOIN profile f USING (user_id) CROSS JOIN hot h WHERE coalesce(user_tier, 'cold') <> 'warm') GROUP BY 1, 2""",
    "scored": f"""SELECT *, {_mm("cfs", "(PARTITION BY user_id)")} AS n1, {_mm("aff", "(PARTITION BY user_id)")} AS n2, {_mm("popularity_score", "(PARTITION BY user_id)")} AS n3,
        {_mm("smoothed_rating", "(PARTITION BY user_id)")} AS n4, {_mm("recency_score", "(PARTITION BY user_id)")} AS n5
      FROM (SELECT c.*, p.product_name, p.category_name AS category, p.price, p.popularity_score, p.smoothed_rating, p.recency_score, p.popularity_category_rank, supporting_anchors, top_anchor,
          {_r("coalesce(cf_score, 0)", 9)} AS cfs, coalesce(category_affinity, 0) AS aff, u.preference_rank, coalesce(momentum, 1) AS mom
        FROM pool c JOIN pop p USING (product_id) LEFT JOIN cf ON cf.user_id = c.user_id AND cf.product_id = c.product_id
        LEFT JOIN ucp u ON u.user_id = c.user_id AND u.category_id = p.category_id LEFT JOIN trend t ON t.product_id = c.product_id
        WHERE is_active AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = c.user_id AND o.product_id = c.product_id))""",
    "shelves": f"""SELECT *, {_r("0.0::DOUBLE + n1 * 0.5::DOUBLE + n2 * 0.2::DOUBLE + n3 * 0.15::DOUBLE + n4 * 0.1::DOUBLE + n5 * 0.05::DOUBLE", 6)} AS score FROM scored""",
    "ranked": """SELECT user_id, s.product_id, product_name, category, s.price, score AS recommendation_score,
        CASE WHEN n1 >= 0.8 AND supporting_anchors >= 3 THEN 'Customers who bought ' || coalesce(a.name, '') || ' also bought this, and ' || (supporting_anchors - 1) || ' other items in your history point to it'
          WHEN n1 >= 0.8 THEN 'Similar to ' || coalesce(a.name, '') || ', which you already engaged with'
          WHEN n2 >= 0.7 AND preference_rank = 1 THEN 'Number ' || popularity_category_rank || ' in ' || category || ', the category you shop most'
          WHEN n2 >= 0.7 THEN 'Number ' || popularity_category_rank || ' in ' || category || ', a category you shop regularly'
          WHEN n3 >= 0.8 AND mom > 1.2 THEN 'Trending right now across the store' WHEN n3 >= 0.8 THEN 'Currently popular across the store'
          WHEN cfs > 0 THEN 'Recommended based on your recent activity' ELSE 'Highly rated pick to get you started' END AS recommendation_reason,
        ['collaborative_filtering', 'category_affinity', 'trending'][priority] AS strategy, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, s.product_id) AS recommendation_rank
      FROM shelves s LEFT JOIN products a ON a.product_id = top_anchor QUALIFY recommendation_rank <= 10""",
    "recs": """SELECT * FROM ranked UNION ALL
      SELECT user_id, product_id, product_name, category, price, trending_score, 'Popular across the store', 'trending_fallback', row_number() OVER (PARTITION BY user_id ORDER BY trending_score DESC, product_id) AS k
      FROM served s CROSS JOIN hot h WHERE user_id NOT IN (SELECT user_id FROM ranked) AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = s.user_id AND o.product_id = h.product_id) QUALIFY k <= 10""",
    "popbase": """SELECT user_id, product_id, popularity_score AS score, row_number() OVER (PARTITION BY user_id ORDER BY decayed_engagement DESC, product_id) AS rank
      FROM served s CROSS JOIN pop p WHERE is_active AND NOT EXISTS (SELECT 1 FROM upf f WHERE f.user_id = s.user_id AND f.product_id = p.product_id AND has_purchased) QUALIFY rank <= 10""",
    "cfbase": f"""SELECT user_id, product_id, {_r("cf_score", 6)} AS score, row_number() OVER (PARTITION BY user_id ORDER BY {_r("cf_score", 6)} DESC, product_id) AS rank
      FROM cf c JOIN products p USING (product_id) WHERE is_active AND NOT EXISTS (SELECT 1 FROM upf f WHERE f.user_id = c.user_id AND f.product_id = c.product_id AND has_purchased) QUALIFY rank <= 10""",
    "tokens": f"""SELECT *, {", ".join(f"{_stems(f)} AS t_{f}" for f in ("name", "brand", "subcategory", "description"))} FROM products""",
    "content": f"""SELECT s.product_id AS source_product_id, t.product_id, t.name AS product_name, t.category_name AS category, t.brand, t.price,
        {_r("ln(1 + " + " + ".join(f"{w}::DOUBLE * len(list_filter(t.t_{f}, lambda x: list_contains(s.need, x)))" for f, w in (("name", 1.0), ("brand", 0.4), ("subcategory", 0.4), ("description", 0.2))) + ")", 6)} AS similarity_score,
        CAST(0 AS BIGINT) AS common_users, 'content' AS similarity_basis, 'Similar catalogue entry, no purchase history yet' AS relationship
      FROM (SELECT *, t_name || t_brand || t_subcategory AS need FROM tokens
        WHERE product_id NOT IN (SELECT product_a FROM sim JOIN products p ON p.product_id = product_b WHERE p.is_active)) s
      JOIN (SELECT *, t_name || t_brand || t_subcategory || t_description AS have FROM tokens WHERE is_active) t ON t.product_id <> s.product_id AND list_has_all(t.have, s.need)
      QUALIFY row_number() OVER (PARTITION BY s.product_id ORDER BY similarity_score DESC, t.product_id) <= 10""",
    "hybrid": "SELECT user_id, product_id, recommendation_score AS score, recommendation_rank AS rank FROM recs",
}

_CLOCKS = {
    "behaviour": "SELECT max(interaction_timestamp) + INTERVAL 1 SECOND AS as_of FROM interactions",
    "ledger": "SELECT max(order_date) + INTERVAL 1 SECOND AS as_of FROM ords",
    "replay": "SELECT quantile_disc(interaction_timestamp, 0.8) AS as_of FROM interactions",
}


def _sql(body: str, clock: str = "behaviour", users: str = "users", **more: str) -> str:
    """The body with the expressions it needs, directly or not, before it."""
    named = {**_CTES, "served": _CTES["served"].format(users=users), **more, "clock": _CLOCKS[clock]}
    need: set[str] = set()
    todo = [body]
    while todo:
        for word in set(re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", todo.pop()))) & set(named) - need:
            need.add(word)
            todo.append(named[word])
    first = ["interactions", "ords"]
    order = [n for n in [*first, "clock", *(k for k in named if k not in (*first, "clock", "served")), "served"] if n in need]
    if "served" in need:  # before what reads it, after what it reads
        order.remove("served")
        at = min((order.index(k) for k in ("cf", "pool", "popbase") if k in order), default=len(order))
        order.insert(at, "served")
    return ("WITH " + ",\n".join(f"{n} AS ({named[n]})" for n in order) + "\n" if order else "") + body


def _metrics(table: str, strategy: str, k: int = 10) -> str:
    means = ", ".join(f"{_r(f'avg({x})', 4)} AS {x}" for x in ("precision", "recall", "hit_rate", "ndcg", "served"))
    return f"""SELECT '{strategy}' AS strategy, {k} AS k, coalesce(user_tier, 'overall') AS tier, count(*) AS users, {means}
      FROM (SELECT e.user_id, user_tier, coalesce(hits, 0) / {k}.0::DOUBLE AS precision, coalesce(hits, 0)::DOUBLE / held_out_purchases AS recall,
          CASE WHEN coalesce(hits, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate, CASE WHEN hits IS NULL THEN 0.0::DOUBLE ELSE 1 END AS served,
          coalesce(dcg, 0) / list_sum(list_transform(range(1, least(held_out_purchases, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
        FROM evalu e LEFT JOIN (SELECT r.user_id, count(t.user_id) AS hits, sum(CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg
          FROM {table} r LEFT JOIN truth t ON t.user_id = r.user_id AND t.product_id = r.product_id WHERE rank <= {k} GROUP BY 1) m ON m.user_id = e.user_id) GROUP BY ROLLUP (user_tier)"""


def _coverage(table: str, strategy: str) -> str:
    return f"""SELECT '{strategy}' AS strategy, count(DISTINCT user_id) AS users_sampled, count(DISTINCT r.product_id) AS distinct_products,
        {_r("CAST(count(DISTINCT r.product_id) AS DOUBLE) / (SELECT count(*) FROM products WHERE is_active)", 4)} AS catalogue_coverage,
        {_r("CAST(count(*) FILTER (demand_tier = 'head') AS DOUBLE) / nullif(count(*), 0)", 4)} AS head_share FROM {table} r JOIN pop USING (product_id)"""


_NAMES = {"popularity": "popbase", "collaborative": "cfbase", "hybrid": "hybrid"}
_LAYER = {"user_product_features": "upf", "user_category_preferences": "ucp", "product_popularity": "pop", "product_trend": "trend", "product_similarity": "sim"}
_SOME = "(SELECT user_id FROM evalu ORDER BY user_id LIMIT 300)"
_REV = "CAST(sum(revenue) AS DOUBLE)"
_MON = "CAST(date_trunc('month', order_date) AS DATE)"
_CARD = "product_id, product_name, category_name, brand, price, purchase_count, view_count, smoothed_rating, popularity_score, demand_tier"
_LINKED = "WHERE product_id IN (SELECT product_a FROM sim)"
_BEST = "SELECT product_id FROM lines {w} GROUP BY 1 ORDER BY sum(revenue) DESC, product_id LIMIT 1"


_COLLABORATIVE = """SELECT product_a AS source_product_id, p.product_id, p.name AS product_name, p.category_name AS category, p.brand, p.price, similarity_score, common_users, 'collaborative' AS similarity_basis,
            CASE WHEN same_subcategory AND p.brand = s.brand THEN 'Same range from ' || p.brand WHEN same_subcategory THEN 'Direct alternative' WHEN same_category THEN 'Frequently bought alongside'
              WHEN jaccard_similarity >= 0.1 THEN 'Shoppers pair these up' ELSE 'Discovered through shared audience' END AS relationship
          FROM sim JOIN products p ON p.product_id = product_b JOIN products s ON s.product_id = product_a WHERE p.is_active QUALIFY row_number() OVER (PARTITION BY product_a ORDER BY similarity_score DESC, p.product_id) <= 10"""


def _ledger() -> dict[str, str]:
    return {
        "a01_top_products_revenue": f"""SELECT product_id, name AS product_name, category_name, brand, count(DISTINCT order_id) AS orders, sum(quantity)::BIGINT AS units_sold, {_REV} AS revenue,
            {_r("avg(CAST(revenue AS DOUBLE) / quantity)", 2)} AS average_selling_price, {_pct("sum(revenue)", "sum(sum(revenue)) OVER ()", 3)} AS pct_of_total_revenue
          FROM lines GROUP BY 1, 2, 3, 4 ORDER BY revenue DESC, product_id LIMIT 25""",
        "a02_revenue_by_category": f"""SELECT category_name, count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS customers, {_REV} AS revenue, {_pct("sum(revenue)", "sum(sum(revenue)) OVER ()")} AS pct_of_revenue,
            rank() OVER (ORDER BY sum(revenue) DESC) AS revenue_rank FROM lines GROUP BY 1""",
        "a03_monthly_revenue": f"""SELECT month, orders, active_customers, CAST(r AS DOUBLE) AS revenue, CAST(lag(r) OVER w AS DOUBLE) AS previous_month_revenue, {_pct("(r - lag(r) OVER w)", "lag(r) OVER w")} AS growth_pct,
            CAST(lead(r) OVER w AS DOUBLE) AS next_month_revenue, CAST(sum(r) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_revenue,
            {_r("CAST(sum(r) OVER (ORDER BY month ROWS 2 PRECEDING) AS DOUBLE) / count(*) OVER (ORDER BY month ROWS 2 PRECEDING)", 2)} AS three_month_average
          FROM (SELECT {_MON} AS month, count(*) AS orders, count(DISTINCT user_id) AS active_customers, sum(total_amount) AS r FROM past GROUP BY 1) WINDOW w AS (ORDER BY month)""",
        "a04_average_order_value": f"""SELECT month, n AS orders, {_r("v", 2)} AS average_order_value, {_r("m", 2)} AS median_order_value, bs AS average_basket_size, {_r("avg(v) OVER ()", 2)} AS average_across_all_months
          FROM (SELECT {_MON} AS month, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) / count(*) AS v, quantile_cont(CAST(total_amount AS DOUBLE), 0.5) AS m, {_r("CAST(sum(u) AS DOUBLE) / nullif(count(u), 0)", 2)} AS bs
            FROM past LEFT JOIN (SELECT order_id, sum(quantity) AS u FROM items GROUP BY 1) USING (order_id) GROUP BY 1)""",
        "a05_customer_ltv": f"""SELECT user_id, city, orders, CAST(r AS DOUBLE) AS lifetime_value, {_r("CAST(r AS DOUBLE) / orders", 2)} AS average_order_value, first_order, last_order, CAST(last_order - first_order AS INTEGER) AS customer_lifespan_days,
            ntile(10) OVER (ORDER BY r DESC, user_id) AS value_decile, {_r("percent_rank() OVER (ORDER BY r)", 4)} AS value_percentile
          FROM (SELECT user_id, city, count(*) AS orders, sum(total_amount) AS r, min(order_date)::DATE AS first_order, max(order_date)::DATE AS last_order FROM past JOIN users USING (user_id) GROUP BY 1, 2)
          ORDER BY lifetime_value DESC, user_id LIMIT 50""",
        "a06_repeat_purchase_rate": f"""SELECT acquisition_category, count(*) AS customers, count(*) FILTER (n >= 2) AS repeat_customers, {_pct("count(*) FILTER (n >= 2)", "count(*)")} AS repeat_rate_pct, {_r("avg(n)", 2)} AS average_orders_per_customer
          FROM (SELECT f.user_id, n, category_name AS acquisition_category FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM past QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY order_date, order_id) = 1) f
            JOIN lines l ON l.order_id = f.order_id QUALIFY row_number() OVER (PARTITION BY f.user_id ORDER BY revenue DESC, l.product_id) = 1) GROUP BY 1""",
        "a07_purchase_frequency": f"""SELECT frequency_band, customers, total_orders, {_pct("customers", "sum(customers) OVER ()")} AS pct_of_customers, {_pct("total_orders", "sum(total_orders) OVER ()")} AS pct_of_orders,
            {_pct("sum(customers) OVER (ORDER BY frequency_band ROWS UNBOUNDED PRECEDING)", "sum(customers) OVER ()")} AS cumulative_pct_customers
          FROM (SELECT CASE WHEN n > 20 THEN '21 or more orders' WHEN n > 10 THEN '11 to 20 orders' WHEN n > 5 THEN '06 to 10 orders' WHEN n > 2 THEN '03 to 05 orders' WHEN n = 2 THEN '02 orders' ELSE '01 order' END AS frequency_band,
            count(*) AS customers, sum(n)::BIGINT AS total_orders FROM (SELECT user_id, count(*) AS n FROM past GROUP BY 1) GROUP BY 1)""",
        "a12_market_basket": f"""SELECT ia AS product_a_id, ib AS product_b_id, pa.name AS product_a, pb.name AS product_b, pa.category_name AS category_a, pb.category_name AS category_b, t AS baskets_together, {_pct("t", "total", 4)} AS support_pct,
            {_pct("t", "fa.n")} AS confidence_a_to_b_pct, {_pct("t", "fb.n")} AS confidence_b_to_a_pct, {_r("CAST(t AS DOUBLE) * total / (fa.n * fb.n)", 2)} AS lift
          FROM (SELECT x.product_id AS ia, y.product_id AS ib, count(*) AS t FROM lines x JOIN lines y ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY 1, 2 HAVING count(*) >= 2)
          JOIN (SELECT product_id, count(*) AS n FROM lines GROUP BY 1) fa ON fa.product_id = ia JOIN (SELECT product_id, count(*) AS n FROM lines GROUP BY 1) fb ON fb.product_id = ib
          JOIN products pa ON pa.product_id = ia JOIN products pb ON pb.product_id = ib CROSS JOIN (SELECT count(DISTINCT order_id) AS total FROM lines) ORDER BY lift DESC, t DESC, ia, ib LIMIT 25""",
        "a15_consecutive_months": f"""SELECT user_id, city, consecutive_months, streak_start, streak_end, revenue_during_streak FROM (
            SELECT user_id, count(DISTINCT m) AS consecutive_months, min(m) AS streak_start, max(m) AS streak_end, CAST(sum(total_amount) AS DOUBLE) AS revenue_during_streak
            FROM (SELECT user_id, {_MON} AS m, total_amount, year(order_date) * 12 + month(order_date) - dense_rank() OVER (PARTITION BY user_id ORDER BY {_MON}) AS g FROM past) GROUP BY user_id, g) JOIN users USING (user_id)
          WHERE consecutive_months >= 3 ORDER BY consecutive_months DESC, revenue_during_streak DESC, user_id, streak_start LIMIT 25""",
        "a16_cohort_retention": f"""SELECT cohort_month, month_offset, cohort_users, active_users, {_pct("active_users", "cohort_users")} AS retention_pct FROM (
            SELECT g.cohort_month, g.cohort_users, k AS month_offset, count(DISTINCT a.user_id) AS active_users
            FROM (SELECT date_trunc('month', signup_date)::DATE AS cohort_month, count(*) AS cohort_users, unnest(range(12)) AS k FROM users GROUP BY 1) g
            LEFT JOIN (SELECT o.user_id, date_trunc('month', signup_date)::DATE AS c, datediff('month', date_trunc('month', signup_date), date_trunc('month', order_date)) AS d FROM past o JOIN users USING (user_id)) a
              ON a.c = g.cohort_month AND a.d = k GROUP BY 1, 2, 3) ORDER BY cohort_month, month_offset LIMIT 100""",
        "a17_rank_in_category": f"""SELECT category_name, product_id, product_name, brand, CAST(r AS DOUBLE) AS revenue, units, row_number() OVER (PARTITION BY category_id ORDER BY r DESC, product_id) AS row_number_in_category,
            rank() OVER (PARTITION BY category_id ORDER BY units DESC) AS rank_by_units, dense_rank() OVER (PARTITION BY category_id ORDER BY units DESC) AS dense_rank_by_units, {_pct("r", "sum(r) OVER (PARTITION BY category_id)")} AS pct_of_category_revenue
          FROM (SELECT product_id, name AS product_name, category_id, category_name, brand, sum(revenue) AS r, sum(quantity)::BIGINT AS units FROM lines GROUP BY ALL) ORDER BY category_name, r DESC, product_id LIMIT 200""",
        "a18_pareto": f"""SELECT row_number() OVER w AS revenue_rank, product_id, product_name, category_name, CAST(r AS DOUBLE) AS revenue, {_pct("r", "sum(r) OVER ()", 4)} AS pct_of_revenue,
            {_pct("sum(r) OVER (ORDER BY r DESC, product_id ROWS UNBOUNDED PRECEDING)", "sum(r) OVER ()")} AS cumulative_pct_of_revenue, {_pct("row_number() OVER w", "count(*) OVER ()")} AS cumulative_pct_of_catalogue
          FROM (SELECT product_id, name AS product_name, category_name, sum(revenue) AS r FROM lines GROUP BY ALL) WINDOW w AS (ORDER BY r DESC, product_id) ORDER BY revenue_rank LIMIT 100""",
        "a19_top_decile_customers": f"""SELECT count(*) AS top_decile_customers, CAST(sum(r) AS DOUBLE) AS top_decile_revenue, {_pct("sum(r)", "max(t)")} AS pct_of_all_revenue, {_r("CAST(sum(r) AS DOUBLE) / count(*)", 2)} AS average_revenue_per_customer,
            {_r("avg(n)", 2)} AS average_orders_per_customer FROM (SELECT *, percent_rank() OVER (ORDER BY r) AS p, sum(r) OVER () AS t FROM (SELECT user_id, count(*) AS n, sum(total_amount) AS r FROM past GROUP BY 1)) WHERE p >= 0.9""",
        "a21_category_crossover": f"""SELECT x.category_name AS category_a, y.category_name AS category_b, count(*) AS shared_customers, {_pct("count(*)", "any_value(x.n)")} AS pct_of_a_who_also_buy_b, {_pct("count(*)", "any_value(y.n)")} AS pct_of_b_who_also_buy_a,
            {_r("CAST(count(*) AS DOUBLE) / (any_value(x.n) + any_value(y.n) - count(*))", 4)} AS jaccard_overlap
          FROM who x JOIN who y ON x.user_id = y.user_id AND x.category_id < y.category_id GROUP BY 1, 2""",
        "a22_price_bands": f"""SELECT price_band, {_r("min(price)", 2)} AS band_min_price, {_r("max(price)", 2)} AS band_max_price, count(*) AS products, coalesce(sum(q), 0)::BIGINT AS units_sold, CAST(coalesce(sum(r), 0) AS DOUBLE) AS revenue,
            {_pct("coalesce(sum(r), 0)", "sum(coalesce(sum(r), 0)) OVER ()")} AS pct_of_revenue
          FROM (SELECT product_id, price, CAST(CASE WHEN price < 900 THEN 0 WHEN price >= 1000 THEN 7 ELSE 1 + floor((ln(price) - ln(900.0::DOUBLE)) / (ln(1000.0::DOUBLE) - ln(900.0::DOUBLE)) * 6) END AS INTEGER) AS price_band FROM products)
          LEFT JOIN (SELECT product_id, sum(quantity) AS q, sum(revenue) AS r FROM items GROUP BY 1) USING (product_id) GROUP BY 1""",
        "a23_brand_performance": f"""SELECT category_name, brand, products, customers, CAST(r AS DOUBLE) AS revenue, average_rating, rank() OVER (PARTITION BY category_name ORDER BY r DESC) AS rank_in_category,
            {_pct("r", "sum(r) OVER (PARTITION BY category_name)")} AS share_of_category_pct, {_r("CAST(r AS DOUBLE) - CAST(sum(r) OVER (PARTITION BY category_name) AS DOUBLE) / count(*) OVER (PARTITION BY category_name)", 2)} AS revenue_vs_category_average
          FROM (SELECT category_name, brand, count(DISTINCT l.product_id) AS products, count(DISTINCT user_id) AS customers, sum(revenue) AS r, {_r("avg(coalesce(s, 3.5))", 2)} AS average_rating
            FROM lines l LEFT JOIN (SELECT product_id, avg(rating) AS s FROM stars GROUP BY 1) USING (product_id) GROUP BY 1, 2)""",
        "a24_new_vs_returning": f"""SELECT {_MON} AS month, count(*) FILTER (order_date = f) AS acquisition_orders, count(*) FILTER (order_date > f) AS returning_orders, CAST(sum(total_amount) FILTER (order_date = f) AS DOUBLE) AS acquisition_revenue,
            CAST(sum(total_amount) FILTER (order_date > f) AS DOUBLE) AS returning_revenue, {_pct("sum(total_amount) FILTER (order_date > f)", "sum(total_amount)")} AS pct_revenue_from_returning
          FROM (SELECT *, first_value(order_date) OVER (PARTITION BY user_id ORDER BY order_date) AS f FROM past) GROUP BY 1""",
        "a25_order_cadence": f"""SELECT user_id, city, g + 1 AS orders, a AS average_gap_days, sd AS gap_stddev, l::DATE AS last_order, d AS days_since_last_order, {_r("CAST(d AS DOUBLE) / nullif(a, 0)", 2)} AS cadence_multiple,
            CASE WHEN d > a * 3 THEN 'at risk' WHEN d > a * 2 THEN 'slipping' ELSE 'on cadence' END AS churn_signal
          FROM (SELECT user_id, count(gap) AS g, {_r("avg(gap)", 1)} AS a, {_r("stddev_samp(gap)", 1)} AS sd, max(order_date) AS l, CAST(datediff('day', max(order_date), (SELECT as_of FROM clock)) AS INTEGER) AS d
            FROM (SELECT *, datediff('day', lag(order_date) OVER (PARTITION BY user_id ORDER BY order_date, order_id), order_date) AS gap FROM past) GROUP BY 1) JOIN users USING (user_id)
          WHERE g >= 4 ORDER BY cadence_multiple DESC NULLS FIRST, user_id LIMIT 25""",
        "d_revenue_by_category": f"SELECT category_name, {_REV} AS revenue, count(DISTINCT order_id) AS orders FROM lines GROUP BY 1",
        "d_monthly_revenue": f"SELECT {_MON} AS month, CAST(sum(total_amount) AS DOUBLE) AS revenue, count(*) AS orders FROM past GROUP BY 1",
        "q_order_totals": "SELECT count(*) AS violations FROM ords JOIN (SELECT order_id, sum(revenue) AS r FROM items GROUP BY 1) USING (order_id) WHERE abs(total_amount - r) > 0.01",
    }


def _behaviour() -> dict[str, str]:
    act = "count(*) FILTER (interaction_type = '{}')".format
    text = lambda f: f"' ' || array_to_string({_stems(f)}, ' ') || ' '"
    fields = (("name", 1.0), ("brand", 0.4), ("subcategory", 0.4), ("description", 0.2))
    words = ("bolt", "gear", "red", "small", "widget")
    occurs = " + ".join(f"len(list_filter(string_split(x_{f}, ' '), lambda t: t = '{w}')) * {v}::DOUBLE" for f, v in fields for w in words)
    has = lambda p: "(" + " OR ".join(f"contains(x_{f}, ' {p} ')" for f, _ in fields) + ")"
    near = " + ".join(f"CASE WHEN contains(x_{f}, ' {p} ') THEN {v}::DOUBLE ELSE 0 END" for f, v in fields for p in ("small bolt", "red widget"))
    matched = f"""SELECT product_id, name AS product_name, category_name AS category, brand, price, {_r(f"ln(1 + {occurs} + {near})", 6)} AS text_rank
            FROM (SELECT *, {", ".join(f"{text(f)} AS x_{f}" for f, _ in fields)} FROM products)
            WHERE is_active AND (({has("small")} AND {has("bolt")}) OR {has("red widget")} OR {has("gear")}) AND NOT {has("hot")}"""
    searched = f"""SELECT product_id, product_name, category, brand, price, text_rank, {_r(_mm("text_rank", "()", 1) + " * 0.7::DOUBLE + " + _mm("popularity_score", "()", 1) + " * 0.3::DOUBLE", 6)} AS blended_score
          FROM ({matched}) JOIN (SELECT product_id, popularity_score FROM pop) USING (product_id) ORDER BY blended_score DESC, product_id LIMIT 20"""
    return {
        "a08_most_viewed": f"""SELECT product_id, name AS product_name, category_name, {act("view")} AS views, count(DISTINCT user_id) FILTER (interaction_type = 'view') AS unique_viewers, {act("cart")} AS carts, {act("purchase")} AS purchases,
            {_r(f"CAST({act('view')} AS DOUBLE) / nullif(count(DISTINCT user_id) FILTER (interaction_type = 'view'), 0)", 2)} AS views_per_viewer FROM log JOIN products USING (product_id) GROUP BY 1, 2, 3 ORDER BY views DESC, product_id LIMIT 25""",
        "a09_highest_converting": f"""SELECT product_id, name AS product_name, category_name, price, {act("view")} AS views, {act("cart")} AS carts, {act("purchase")} AS purchases, {_pct(act("cart"), act("view"))} AS view_to_cart_pct,
            {_pct(act("purchase"), act("cart"))} AS cart_to_purchase_pct, {_pct(act("purchase"), act("view"))} AS view_to_purchase_pct FROM log JOIN products USING (product_id) GROUP BY 1, 2, 3, 4 HAVING {act("view")} >= 10
          ORDER BY view_to_purchase_pct DESC NULLS LAST, product_id LIMIT 25""",
        "a10_trending_4w": f"""SELECT product_id, name AS product_name, category_name, p AS prior_events, r AS recent_events, rp AS recent_purchases, {_r("CAST(r AS DOUBLE) / nullif(p, 0)", 3)} AS growth_multiple,
            CASE WHEN p = 0 THEN 'newly discovered' WHEN r > p * 1.5 THEN 'surging' WHEN r > p * 1.1 THEN 'rising' WHEN r < p * 0.7 THEN 'cooling' ELSE 'steady' END AS trend_label
          FROM (SELECT product_id, count(*) FILTER (back <= INTERVAL 28 DAY) AS r, count(*) FILTER (back > INTERVAL 28 DAY) AS p, count(*) FILTER (back <= INTERVAL 28 DAY AND interaction_type = 'purchase') AS rp
            FROM (SELECT *, (SELECT as_of FROM clock) - interaction_timestamp AS back FROM log) WHERE back <= INTERVAL 56 DAY GROUP BY 1) JOIN products USING (product_id) WHERE r >= 20
          ORDER BY growth_multiple DESC NULLS LAST, r DESC, product_id LIMIT 25""",
        "a11_favourite_categories": f"""SELECT user_id, persona AS generated_persona, c[1].category_name AS favourite_category, c[1].interaction_score AS favourite_score, c[2].category_name AS second_category, c[2].interaction_score AS second_score,
            c[3].category_name AS third_category, {_r("CAST(c[1].interaction_score AS DOUBLE) / nullif(t, 0)", 3)} AS favourite_concentration
          FROM (SELECT user_id, list({{'category_name': category_name, 'interaction_score': interaction_score}} ORDER BY interaction_score DESC, category_id) AS c, sum(interaction_score) AS t FROM ucp GROUP BY 1) JOIN users USING (user_id) ORDER BY user_id LIMIT 50""",
        "a13_top_seller_neighbours": f"""SELECT s.name AS source_product, p.name AS neighbour, p.category_name, p.subcategory, common_users, cosine_similarity, jaccard_similarity, neighbour_rank,
            CASE WHEN same_subcategory THEN 'substitute' WHEN same_category THEN 'complement in the same aisle' ELSE 'cross category affinity' END AS relationship
          FROM sim JOIN products s ON s.product_id = product_a JOIN products p ON p.product_id = product_b WHERE product_a = ({_BEST.format(w=_LINKED)}) ORDER BY cosine_similarity DESC, product_b LIMIT 15""",
        "a14_bought_x_not_y": f"""SELECT (SELECT name FROM products WHERE product_id = ax.product_id) AS bought_this, (SELECT name FROM products WHERE product_id = ay.product_b) AS but_not_this, user_id, city, count(DISTINCT order_id) AS orders_with_anchor, {_REV} AS spend_on_anchor
          FROM lines JOIN ({_BEST.format(w=_LINKED)}) ax USING (product_id) JOIN users USING (user_id) LEFT JOIN (SELECT product_b FROM sim WHERE product_a = ({_BEST.format(w=_LINKED)}) ORDER BY similarity_score DESC, product_b LIMIT 1) ay ON true
          WHERE user_id NOT IN (SELECT l2.user_id FROM lines l2 JOIN (SELECT product_b FROM sim WHERE product_a = ({_BEST.format(w=_LINKED)}) ORDER BY similarity_score DESC, product_b LIMIT 1) z ON z.product_b = l2.product_id)
          GROUP BY 1, 2, 3, 4 ORDER BY spend_on_anchor DESC, user_id LIMIT 25""",
        "a20_conversion_funnel": f"""SELECT funnel_stage, interaction_type, events, users, products, lag(events) OVER w AS previous_stage_events, {_pct("events", "lag(events) OVER w")} AS stage_conversion_pct, {_pct("events", "first_value(events) OVER w")} AS pct_of_top_of_funnel
          FROM (SELECT list_position(['view', 'wishlist', 'cart', 'purchase'], interaction_type) AS funnel_stage, interaction_type, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products FROM log GROUP BY 1, 2) WINDOW w AS (ORDER BY funnel_stage)""",
        "user_product_features": "SELECT * FROM upf",
        "user_category_preferences": "SELECT * FROM ucp",
        "product_popularity": "SELECT * FROM pop",
        "product_trend": "SELECT * FROM trend",
        "product_similarity": "SELECT * FROM sim",
        "user_recommendation_profile": "SELECT * FROM profile",
        "layer_refresh": " UNION ALL ".join(f"SELECT '{name}' AS layer, count(*) AS rows_loaded FROM {table}" for name, table in _LAYER.items()),
        "trending_products": "SELECT * FROM hot ORDER BY trending_score DESC, product_id LIMIT 10",
        "recommendations": "SELECT * FROM recs",
        "similar_products": f"{_COLLABORATIVE} UNION ALL SELECT * FROM content",
        "similar_products_content": "SELECT * FROM content",
        "api_similar": f"SELECT * FROM ({_COLLABORATIVE} UNION ALL SELECT * FROM content) WHERE source_product_id = 7",
        "api_health": "SELECT 'ok' AS status, 'production' AS pipeline_mode, as_of AS pipeline_as_of, (SELECT count(*) FROM sim) AS similarity_pairs, (SELECT count(*) FROM products WHERE is_active) AS products FROM clock",
        "q_no_owned_leak": "SELECT count(*) AS violations FROM recs JOIN owned USING (user_id, product_id)",
        "q_no_inactive": "SELECT count(*) AS violations FROM recs JOIN products USING (product_id) WHERE NOT is_active",
        "b4_text_search": f"SELECT product_id, product_name AS name, text_rank AS rank FROM ({matched}) ORDER BY rank DESC, product_id LIMIT 20",
        "api_search": f"SELECT * EXCLUDE (text_rank) FROM ({searched})",
        "search_products": searched,
        "b1_anchor_lookup": f"SELECT product_id, CAST(sum({_W}) AS BIGINT) AS score FROM log WHERE user_id = 1 GROUP BY 1 ORDER BY score DESC, product_id LIMIT 50",
        "b2_recent_demand": f"SELECT count(*) AS events, {act('purchase')} AS purchases, count(DISTINCT user_id) AS users FROM log WHERE product_id = 7 AND interaction_timestamp >= (SELECT as_of FROM clock) - INTERVAL 28 DAY",
        "b3_neighbour_lookup": f"SELECT product_b, {_r('sum(CAST(similarity_score AS DECIMAL(18,6)))', 6)} AS score FROM sim WHERE product_a IN (1, 2, 3, 5, 8, 13) GROUP BY 1 ORDER BY score DESC, product_b LIMIT 100",
        "b5_purchase_exclusion": "SELECT DISTINCT product_id FROM log WHERE user_id = 1 AND interaction_type = 'purchase'",
        "d_tier_counts": "SELECT user_tier, count(*) AS users FROM profile GROUP BY 1",
        "d_user_sample": "SELECT user_id, distinct_products FROM profile WHERE user_tier = 'warm' ORDER BY user_id LIMIT 400",
        "d_user_profile": "SELECT user_id, city, persona, user_tier, distinct_products, total_interactions, purchased_products, distinct_categories FROM profile JOIN users USING (user_id) WHERE user_id = 1",
        "d_category_prefs": "SELECT category_name, category_affinity, interaction_score, purchase_count, preference_rank FROM ucp WHERE user_id = 1",
        "d_purchase_history": """SELECT order_id, product_id, order_date::DATE AS ordered, name AS product_name, category_name, quantity, CAST(revenue AS DOUBLE) AS line_total FROM ords JOIN items USING (order_id) JOIN products USING (product_id)
          WHERE user_id = 1 ORDER BY ordered DESC, order_id DESC, product_id LIMIT 40""",
        "d_product_card": f"SELECT {_CARD}, popularity_global_rank FROM pop WHERE product_id = 7",
        "d_popular_products": f"SELECT {_CARD} FROM pop WHERE is_active ORDER BY popularity_global_rank LIMIT 25",
        "d_pipeline_state": "SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM products WHERE is_active) AS active_products, (SELECT count(*) FROM log) AS interactions, (SELECT count(*) FROM sim) AS similarity_pairs, as_of FROM clock",
        "q_purchase_has_order_line": "SELECT count(*) AS violations FROM interactions i WHERE interaction_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM ords JOIN items USING (order_id) WHERE ords.user_id = i.user_id AND items.product_id = i.product_id)",
        "q_interaction_after_signup": "SELECT count(*) AS violations FROM interactions JOIN users USING (user_id) WHERE interaction_timestamp::DATE < signup_date",
        "q_weights_sum_to_one": "SELECT 1.0::DOUBLE AS total_weight",
        "q_similarity_symmetric": "SELECT count(*) AS violations FROM sim a JOIN sim b ON a.product_a = b.product_b AND a.product_b = b.product_a WHERE a.similarity_score <> b.similarity_score",
        "q_similarity_range": "SELECT count(*) AS violations FROM sim WHERE similarity_score NOT BETWEEN 0 AND 1.000001 OR jaccard_similarity NOT BETWEEN 0 AND 1",
        "q_no_self_neighbour": "SELECT count(*) AS violations FROM sim WHERE product_a = product_b",
        "q_support_floor": "SELECT count(*) AS violations FROM sim WHERE common_users < 3",
        "q_affinity_sums_to_one": "SELECT count(*) AS violations FROM (SELECT sum(category_affinity) AS s FROM ucp GROUP BY user_id) WHERE abs(s - 1) > 0.001",
    }


def all_sql() -> dict[str, str]:
    who = "SELECT DISTINCT l.user_id, l.category_id, l.category_name, n FROM lines l JOIN (SELECT category_id, count(DISTINCT user_id) AS n FROM lines GROUP BY 1) USING (category_id)"
    out = {k: _sql(v, "ledger", **({"who": who} if "who" in v else {})) for k, v in _ledger().items()}
    out |= {k: _sql(v) for k, v in _behaviour().items()}
    out |= {
        "evaluation_cutoff": _sql("SELECT as_of AS cutoff FROM clock", "replay"),
        "eval_ground_truth": _sql("SELECT * FROM truth", "replay"),
        "eval_candidate_users": _sql("SELECT * FROM evalu", "replay"),
        "eval_split_stats": _sql("SELECT count(*) FILTER (b) AS train_events, count(*) FILTER (NOT b) AS test_events, count(*) FILTER (NOT b AND interaction_type = 'purchase') AS test_purchases FROM (SELECT *, interaction_timestamp < (SELECT as_of FROM clock) AS b FROM interactions)", "replay"),
        "eval_sample_users": _sql("SELECT user_id FROM evalu ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 100", "replay"),
        "popularity_baseline": _sql("SELECT * FROM popbase", "replay", "evalu"),
        "cf_baseline": _sql("SELECT * FROM cfbase", "replay", "evalu"),
    }
    for user, name in ((1, "api_recommendations"), (-1, "api_recommendations_unknown")):
        out[name] = _sql("SELECT recs.*, coalesce(user_tier, 'unknown') AS user_tier FROM recs LEFT JOIN profile USING (user_id)", users=f"(SELECT CAST({user} AS BIGINT) AS user_id)")
    every = [_metrics(table, strategy, k) for strategy, table in _NAMES.items() for k in (5, 10)]
    out["run_evaluation"] = _sql(" UNION ALL ".join(every), "replay", "evalu")
    names = ("precision", "recall", "hit_rate", "ndcg", "served")
    rows = " UNION ALL ".join(f"SELECT strategy, unnest({list(names)}) AS metric, unnest([{', '.join(names)}]) AS value FROM ({_metrics(table, strategy)}) WHERE tier = 'overall'" for strategy, table in _NAMES.items())
    columns = ", ".join(f"max(value) FILTER (strategy = '{strategy}') AS {strategy}" for strategy in _NAMES)
    out["d_eval_pivot"] = _sql(f"SELECT metric, {columns} FROM ({rows}) GROUP BY metric", "replay", "evalu")
    for strategy, table in _NAMES.items():
        out[f"coverage_report_{strategy}"] = _sql(_coverage(table, strategy), "replay", _SOME)
        out[f"metrics_by_tier_{strategy}"] = _sql(_metrics(table, strategy), "replay", "evalu")
    return out
