"""Prepared screenshots: marked and changed regions of pictures whose sizes and places come from part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import vision as V

from .registry import query
from .tool_queries import TYPE, one

IMAGES, WIDTH, HEIGHT = 40, 1920, 1080


def regions(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = t("part").select((k % IMAGES).alias("image"), (k * 37 % 1800).alias("x"), (k * 53 % 1000).alias("y"), (s * 11 + 8).alias("width"), (s * (k % 5 + 1) + 6).alias("height"), ((k % 20) / 100.0).alias("red_ratio"))
    area = F.col("width") * F.col("height")
    return rows.withColumns({"coverage": area / float(WIDTH * HEIGHT), "density": F.col("red_ratio") * 4, "strength": (F.col("x") % 256).cast("double")})


def words(t):
    k = F.col("o_orderkey")
    return t("orders").select((k % IMAGES).alias("image"), k.alias("word_id"), (k * 13 % 1900).alias("x"), (k * 7 % 1060).alias("y"), F.lit(40).alias("width"), F.lit(12).alias("height"), F.col("o_orderstatus").alias("text"), ((k % 100) / 100.0).alias("confidence"))


def images(t):
    return t("part").select((F.col("p_partkey") % IMAGES).alias("image")).distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


REGIONS = f"""g AS (SELECT p_partkey % {IMAGES} AS image, p_partkey * 37 % 1800 AS x, p_partkey * 53 % 1000 AS y, p_size * 11 + 8 AS w, p_size * (p_partkey % 5 + 1) + 6 AS h, (p_partkey % 20) / 100.0::DOUBLE AS red FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y, x, h, w) AS id, w * h / {float(WIDTH * HEIGHT)}::DOUBLE AS cover, red * 4 AS density, (x % 256)::DOUBLE AS strength FROM g)"""
MIDDLE = lambda at, size, target, most: f"greatest(0, least({most} - 1, floor({at} + {size} / 2.0 - ({target}) / 2.0 + 0.5)))::BIGINT"
END = lambda at, size, target, most: f"greatest({MIDDLE(at, size, target, most)} + 1, least({most}, floor({at} + {size} / 2.0 - ({target}) / 2.0 + ({target}) + 0.5)))::BIGINT"


def box(pad_x: str, pad_y: str, least_w: int, least_h: int) -> str:
    """x:y:width:height of an expanded box in SQL."""
    w, h = f"greatest({least_w}, w + 2 * ({pad_x}))", f"greatest({least_h}, h + 2 * ({pad_y}))"
    x, y = MIDDLE("x", "w", w, WIDTH), MIDDLE("y", "h", h, HEIGHT)
    return f"{x} || ':' || {y} || ':' || ({END('x', 'w', w, WIDTH)} - {x}) || ':' || ({END('y', 'h', h, HEIGHT)} - {y})"


TOKENS = "ceil(split_part(crop, ':', 3)::BIGINT * split_part(crop, ':', 4)::BIGINT / 750.0)::BIGINT"
as_text = lambda c: F.concat_ws(":", *(F.col(f"{c}.{k}").cast("string") for k in ("x", "y", "width", "height"))).alias(c)

SHOT = f"""WITH {REGIONS}, o AS (SELECT o_orderkey % {IMAGES} AS image, o_orderkey AS id, o_orderkey * 13 % 1900 AS x, o_orderkey * 7 % 1060 AS y, o_orderstatus AS text, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders),
m AS (SELECT o.*, r.id AS region, row_number() OVER (PARTITION BY o.image, o.id ORDER BY r.w * r.h, r.id) AS best FROM o JOIN r ON r.image = o.image AND o.x + 20 >= r.x AND o.x + 20 < r.x + r.w AND o.y + 6 >= r.y AND o.y + 6 < r.y + r.h),
t AS (SELECT image, region, string_agg(text, ' ' ORDER BY y, x, id) AS text, floor(avg(confidence) * 1000.0 + 0.5) / 1000.0 AS confidence, count(*) AS words FROM m WHERE best = 1 GROUP BY ALL),
k AS (SELECT r.*, {TYPE} AS kind, t.text, t.confidence, t.words FROM r LEFT JOIN t ON t.image = r.image AND t.region = r.id),
p AS (SELECT *, floor((CASE kind WHEN 'comment_box' THEN 0.95::DOUBLE WHEN 'outline' THEN 0.82 WHEN 'arrow' THEN 0.78 WHEN 'underline' THEN 0.72 WHEN 'marker_dot' THEN 0.66 ELSE 0.56 END * 0.45::DOUBLE + {one('sqrt(greatest(1, w * h) / 60000)')} * 0.2::DOUBLE + {one('cover * 28')} * 0.2::DOUBLE + {one('red * 3.5::DOUBLE')} * 0.05::DOUBLE + coalesce(confidence, 0.0) * 0.1::DOUBLE) * 1000.0 + 0.5) / 1000.0 AS priority, {box('24', '24', 220, 140)} AS crop, {box('greatest(90, floor(w * 1.25::DOUBLE + 0.5))', 'greatest(70, floor(h * 1.25::DOUBLE + 0.5))', 420, 260)} AS context FROM k),
n AS (SELECT image, id AS region_id, row_number() OVER (PARTITION BY image ORDER BY priority DESC, id) AS nav_rank, kind, priority, priority >= 0.62 AS include_by_default, crop, context, CASE WHEN length(text) >= 3 AND confidence >= 0.45 THEN text END AS ocr_hint, words, {TOKENS} AS tokens FROM p),
s AS (SELECT *, max(include_by_default::INT) OVER (PARTITION BY image) AS chosen FROM n), u AS (SELECT * EXCLUDE (chosen), sum(tokens) OVER (PARTITION BY image ORDER BY nav_rank) AS spent, row_number() OVER (PARTITION BY image ORDER BY nav_rank) AS place FROM s WHERE chosen = 0 OR include_by_default)"""


@query("prepare_screenshot", f"{SHOT} SELECT n.*, u.spent::BIGINT AS spent FROM n LEFT JOIN u ON u.image = n.image AND u.region_id = n.region_id AND u.spent <= 1500")
def prepare_screenshot(t):
    """The regions of every marked picture, and which of them fit into 1500 tokens."""
    rows = V.with_spent(V.annotated_regions(regions(t), words(t), images(t)), 1500)
    return rows.select("image", "region_id", "nav_rank", "kind", "priority", "include_by_default", as_text("crop"), as_text("context"), "ocr_hint", "words", "tokens", "spent")


@query("prepare_screenshot_diff", f"""WITH {REGIONS}, p AS (SELECT *, floor(({one('sqrt(greatest(1, w * h) / 90000)')} * 0.4::DOUBLE + {one('cover * 36')} * 0.25::DOUBLE + {one('density * 1.8::DOUBLE')} * 0.2::DOUBLE + {one('strength / 220')} * 0.15::DOUBLE) * 1000.0 + 0.5) / 1000.0 AS priority,
CASE WHEN strength >= 180 AND density >= 0.55 THEN 'color_change' WHEN h <= 80 AND w / h::DOUBLE >= 2.8 THEN 'text_change' WHEN cover >= 0.015 OR w * h >= 120000 THEN 'layout_shift' WHEN strength >= 130 THEN 'asset_change' ELSE 'unknown' END AS impact, {box('24', '24', 220, 160)} AS crop, {box('greatest(96, floor(w * 1.15::DOUBLE + 0.5))', 'greatest(72, floor(h * 1.15::DOUBLE + 0.5))', 420, 280)} AS context FROM r)
SELECT image, id AS region_id, row_number() OVER (PARTITION BY image ORDER BY priority DESC, id) AS nav_rank, impact, priority, priority >= 0.58 AS include_by_default, crop, context, 2 * {TOKENS} AS tokens FROM p""")
def prepare_screenshot_diff(t):
    rows = V.changed_regions(regions(t), images(t))
    return rows.select("image", "region_id", "nav_rank", "impact", "priority", "include_by_default", as_text("crop"), as_text("context"), "tokens")
