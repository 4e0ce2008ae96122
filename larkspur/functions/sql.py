"""The layer for SQL callers: views of its relations, scalar and table functions."""

from __future__ import annotations

from larkspur.context import FUNNEL
from larkspur.operators import serving
from larkspur.operators.features import RELATIONS, Layer


def _functions(layer: Layer) -> dict[str, str]:
    c, at = layer.context, layer.context.as_of.isoformat(sep=" ")
    weights = " ".join(f"WHEN '{kind}' THEN {w}" for kind, (w, _) in FUNNEL.items())
    settings = " ".join(f"WHEN '{key}' THEN {float(value)}D" for key, value in c.settings.items())
    age = "CAST(unix_micros(CAST(now AS TIMESTAMP)) - unix_micros(CAST(at AS TIMESTAMP)) AS DOUBLE) / 86400000000D"
    return {
        "rec_as_of()": f"RETURNS TIMESTAMP_NTZ RETURN TIMESTAMP_NTZ '{at}'",
        "rec_setting(name STRING)": f"RETURNS DOUBLE RETURN CASE name {settings} END",
        "rec_weight(kind STRING)": f"RETURNS INT RETURN CASE kind {weights} ELSE 0 END",
        "rec_decay(at TIMESTAMP_NTZ, now TIMESTAMP_NTZ, half_life DOUBLE)": f"RETURNS DOUBLE RETURN power(0.5D, greatest({age}, 0D) / half_life)",
        "get_trending_products(most INT)": "RETURNS TABLE (product_id BIGINT, product_name STRING, category STRING, price DOUBLE, trending_score DOUBLE, trend_direction STRING) RETURN "
        + _first("product_id, product_name, category, price, trending_score, trend_direction", "trending_products", "trending_score DESC, product_id"),
        "get_neighbours(product BIGINT, most INT)": "RETURNS TABLE (product_id BIGINT, similarity_score DOUBLE, common_users BIGINT) RETURN "
        + _first("product_b, similarity_score, common_users", "product_similarity WHERE product_a = product", "similarity_score DESC, product_b"),
        "get_preferences(of_user BIGINT, most INT)": "RETURNS TABLE (category_name STRING, category_affinity DOUBLE, preference_rank INT) RETURN "
        + _first("category_name, category_affinity, preference_rank", "user_category_preferences WHERE user_id = of_user", "preference_rank"),
    }


def _first(columns: str, source: str, order: str) -> str:
    """The first ``most`` rows, an argument, which LIMIT does not take."""
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM {source}) WHERE place <= most"


def install(layer: Layer) -> list[str]:
    """Create temporary views of the layer's relations and its functions; returns their names.

    Meant for a written layer (``stored``): the views read its files. Installing
    another layer replaces them.
    """
    spark = layer.retail.spark
    for name in RELATIONS:
        getattr(layer, name).createOrReplaceTempView(name)
    layer.user_profile.createOrReplaceTempView("user_recommendation_profile")
    serving.trending(layer, serving.TRENDING_POOL).createOrReplaceTempView("trending_products")
    made = _functions(layer)
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} {body}")
    return [*RELATIONS, "user_recommendation_profile", "trending_products", *(s.partition("(")[0] for s in made)]
