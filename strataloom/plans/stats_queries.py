"""Statistics, graphs, traces, rasters and receipts on the tables of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import compact as C
from strataloom.operators import graph as G
from strataloom.operators import raster as X
from strataloom.operators import receipts as A
from strataloom.operators import stats as S
from strataloom.operators import trace as W
from strataloom.session import scratch
from strataloom.sources import images as IM

from .registry import SQL, query
from .text_queries import RUNS

def HORNER(x: str, coefficients: tuple[float, ...]) -> str:
    """A polynomial in SQL, the highest power first."""
    out = f"({coefficients[0]!r})::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * ({x}) + ({c!r})::DOUBLE)"
    return out


Z = S.Z95


@query("agg_wilson", f"""WITH a AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source), p AS (SELECT *, k / n AS p, 1 + {Z * Z} / n AS d FROM a)
SELECT source, k, n, greatest(0.0, (p + {Z * Z} / (2 * n)) / d - {Z} / d * sqrt(p * (1 - p) / n + {Z * Z} / (4 * n * n))) AS low, least(1.0, (p + {Z * Z} / (2 * n)) / d + {Z} / d * sqrt(p * (1 - p) / n + {Z * Z} / (4 * n * n))) AS high FROM p""")
def agg_wilson(t):
    a = t("documents").join(t("labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return a.select("source", "k", "n", low.alias("low"), high.alias("high"))


WELCH = """m AS (SELECT event_type AS g, count(value) AS n, avg(value) AS mean, var_samp(value) AS var FROM events GROUP BY 1),
p AS (SELECT a.g || ' vs ' || b.g AS pair, (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) AS t, pow(a.var / a.n + b.var / b.n, 2) / (pow(a.var / a.n, 2) / (a.n - 1) + pow(b.var / b.n, 2) / (b.n - 1)) AS df, (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) AS d FROM m a JOIN m b ON a.g < b.g)"""


#: erf by its series in gamma functions, which is another one than the operator's.
ERF = "CASE WHEN z = 0 THEN 0.0 ELSE list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(z) - lgamma(n + 1.5) - z * z))) END"


@query("agg_welch", f"WITH {WELCH}, z AS (SELECT *, abs(t) / sqrt(2.0) AS z FROM p) SELECT pair, floor(t * 1e6 + 0.5) / 1e6 AS t, floor(df * 1e3 + 0.5) / 1e3 AS df, floor((1 - {ERF}) * 1e8 + 0.5) / 1e8 AS p FROM z")
def agg_welch(t):
    r = S.pairwise(t("events"), "event_type", "value")
    return r.select("pair", (F.floor(F.col("t") * 1e6 + 0.5) / 1e6).alias("t"), (F.floor(F.col("df") * 1e3 + 0.5) / 1e3).alias("df"), (F.floor(F.col("p") * 1e8 + 0.5) / 1e8).alias("p"))


@query("agg_cohens_d", f"WITH {WELCH} SELECT pair, floor(d * 1e6 + 0.5) / 1e6 AS d FROM p")
def agg_cohens_d(t):
    return S.pairwise(t("events"), "event_type", "value").select("pair", (F.floor(F.col("d") * 1e6 + 0.5) / 1e6).alias("d"))


HOLM = "p AS (SELECT event_type AS label, (count(*) % 97) / 500.0::DOUBLE AS p FROM events GROUP BY 1), s AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, label) + 1)) AS step FROM p)"


@query("win_holm", f"WITH {HOLM} SELECT label, p, max(step) OVER (ORDER BY p, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted_p, max(step) OVER (ORDER BY p, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 0.05 AS rejected FROM s")
def win_holm(t):
    p = t("events").groupBy(F.col("event_type").alias("label")).agg(((F.count("*") % 97) / 500.0).alias("p"))
    return S.holm(p, "label", "p")


@query("agg_variance_components", f"""WITH {RUNS}, o AS (SELECT compressor, doc_id AS fixture, 1 - ratio AS b FROM r), g AS (SELECT avg(b) AS mean, var_pop(b) AS total FROM o), c AS (SELECT compressor, fixture, count(*) AS n, var_samp(b) AS v FROM o GROUP BY ALL),
e AS (SELECT min(n) AS runs, sum(v * (n - 1)) / sum(n - 1) AS res FROM c), k AS (SELECT count(*) AS nc, var_samp(m) AS vc FROM (SELECT avg(b) AS m FROM o GROUP BY compressor)), f AS (SELECT count(*) AS nf, var_samp(m) AS vf FROM (SELECT avg(b) AS m FROM o GROUP BY fixture)),
x AS (SELECT mean, total, nc AS compressors, nf AS fixtures, greatest(0.0, (vc * nf * runs - res) / (nf * runs)) AS between_compressor, greatest(0.0, (vf * nc * runs - res) / (nc * runs)) AS between_fixture, res AS residual FROM g, e, k, f)
SELECT floor(mean * 1e6 + 0.5) AS mean, floor(total * 1e6 + 0.5) AS total, compressors, fixtures, floor(between_compressor * 1e6 + 0.5) AS between_compressor, floor(between_fixture * 1e6 + 0.5) AS between_fixture, floor(residual * 1e6 + 0.5) AS residual FROM x""")
def agg_variance_components(t):
    o = C.compressor_runs(t("documents")).select("compressor", F.col("doc_id").alias("fixture"), "b")
    v = S.variance_components(o)
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("double").alias(c)
    return v.select(six("mean"), six("total"), "compressors", "fixtures", six("between_compressor"), six("between_fixture"), six("residual"))


@query("agg_bootstrap")
def agg_bootstrap(t):
    return S.bootstrap(C.compressor_runs(t("documents")), "compressor", "doc_id", "b")


@query("fn_cost_factor", f"WITH {RUNS} SELECT compressor, doc_id, run AS n, (1 - (1 - ratio)) * (1 + (run - 1) * (1 * 0.1 + 1 - 1)) AS cost FROM r")
def fn_cost_factor(t):
    r = C.compressor_runs(t("documents"))
    return r.select("compressor", "doc_id", F.col("run").alias("n"), S.cost_factor(F.col("b"), F.col("run"), F.lit(1)).alias("cost"))


PARETO = "p AS (SELECT p_partkey AS k, p_size::DOUBLE AS a, floor(p_retailprice / 10) AS b, (p_partkey % 17)::DOUBLE AS c FROM part)"


QUANTILE = lambda p: f"CASE WHEN least({p}, 1 - {p}) >= {S.TAIL} THEN {HORNER(f'(({p}) - 0.5) * (({p}) - 0.5)', S.MIDDLE_UP)} * (({p}) - 0.5) / {HORNER(f'(({p}) - 0.5) * (({p}) - 0.5)', S.MIDDLE_DOWN)} ELSE (CASE WHEN {p} < 0.5 THEN 1 ELSE -1 END) * {HORNER(f'sqrt(-2 * ln(least({p}, 1 - {p})))', S.TAIL_UP)} / {HORNER(f'sqrt(-2 * ln(least({p}, 1 - {p})))', S.TAIL_DOWN)} END"
SHARE = "((p_partkey % 9999 + 1) / 10000.0::DOUBLE)"


@query("fn_normal_quantile", f"WITH z AS (SELECT p_partkey, round({QUANTILE(SHARE)}, 9) AS z, {QUANTILE(f'((1 + {SHARE}) / 2)')} AS w, least(p_size, 40)::DOUBLE / 60 AS s FROM part) SELECT p_partkey, z, round(greatest(0.0, (s + w * w / 120) / (1 + w * w / 60) - w / (1 + w * w / 60) * sqrt(s * (1 - s) / 60 + w * w / 14400)), 9) AS low, round(least(1.0, (s + w * w / 120) / (1 + w * w / 60) + w / (1 + w * w / 60) * sqrt(s * (1 - s) / 60 + w * w / 14400)), 9) AS high FROM z")
def fn_normal_quantile(t):
    """Quantiles of shares, and the interval of each part's share of 60 at that confidence."""
    p = (F.col("p_partkey") % 9999 + 1) / F.lit(10000.0)
    low, high = S.wilson_at(F.least("p_size", F.lit(40)), F.lit(60), p)
    return t("part").select("p_partkey", F.round(S.normal_quantile(p), 9).alias("z"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("fn_pareto", f"WITH {PARETO} SELECT * FROM p x WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.a >= x.a AND o.b >= x.b AND o.c >= x.c AND (o.a > x.a OR o.b > x.b OR o.c > x.c))")
def fn_pareto(t):
    p = t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), F.floor(F.col("p_retailprice") / 10).cast("double").alias("b"), (F.col("p_partkey") % 17).cast("double").alias("c"))
    return S.pareto(p, "k", ["a", "b", "c"])


# --- graphs -----------------------------------------------------------------------------------


def followed(t, by: int = 1, returned: bool = False):
    """Edges from each part to the one that stands so many lines further in an order; on demand, if both were returned."""
    l = t("lineitem").filter("l_returnflag = 'R'") if returned else t("lineitem")
    a = l.select("l_orderkey", (F.col("l_linenumber") + by).alias("line"), F.col("l_partkey").alias("src"))
    return a.join(l.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("dst")), ["l_orderkey", "line"]).select("src", "dst").distinct()


FOLLOWED = lambda name, by, where="": f"{name} AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + {by} {where})"
EDGES = FOLLOWED("e", 1)
RETURNED = FOLLOWED("e", 1, "WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'")
LONGEST = 9


@query("graph_import_graph", f"WITH {EDGES} SELECT src, array_to_string(list_sort(list(dst)), ',') AS targets FROM e GROUP BY src")
def graph_import_graph(t):
    return G.adjacency(followed(t)).select("src", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query("graph_neighbors", f"WITH {EDGES}, n AS (SELECT dst AS node, 'out' AS direction FROM e WHERE src = 5 UNION SELECT src, 'in' FROM e WHERE dst = 5), r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY node) AS rank FROM n) SELECT * FROM r WHERE rank <= 40")
def graph_neighbors(t):
    return G.neighbours(followed(t), 5)


@query("join_blast_radius", f"WITH {EDGES}, {FOLLOWED('f', 2)}, b AS (SELECT src AS path, 'imports' AS reason FROM e WHERE dst = 5 UNION SELECT src, 'references' FROM f WHERE dst = 5) SELECT path, string_agg(reason, ',' ORDER BY reason) AS reasons FROM b WHERE path <> 5 GROUP BY path")
def join_blast_radius(t):
    return G.blast_radius(followed(t), followed(t, 2), 5)


@query("graph_cycles", f"""WITH RECURSIVE {RETURNED}, p(start, cur, path) AS (SELECT src, dst, [src] FROM e WHERE dst >= src UNION ALL SELECT start, e.dst, list_append(path, cur) FROM p JOIN e ON e.src = p.cur
WHERE cur > start AND NOT list_contains(path, cur) AND e.dst >= start AND len(path) < {LONGEST}) SELECT array_to_string(path, ',') AS cycle FROM p WHERE cur = start""")
def graph_cycles(t):
    return G.cycles(followed(t, returned=True), LONGEST).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query("graph_components", f"WITH RECURSIVE {RETURNED}, n AS (SELECT DISTINCT src AS a FROM e WHERE src IN (SELECT dst FROM e)), r(a, b) AS (SELECT src, dst FROM e WHERE src IN (SELECT a FROM n) UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS node, max(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1")
def graph_components(t):
    return G.strong_components(followed(t, returned=True))


@query("join_orphans", f"WITH {RETURNED} SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT dst FROM e WHERE src <> dst)")
def join_orphans(t):
    name = lambda c, to: F.col(c).cast("string").alias(to)
    found = G.orphans(t("part").select(name("p_partkey", "path")), followed(t, returned=True).select(name("src", "src"), name("dst", "target")))
    return found.select(F.col("path").cast("bigint").alias("path"))


LINKS = "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"/]+)\"', 1)) AS target FROM pages), f AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS path FROM documents) SELECT page_id, target, count(*) AS n FROM l WHERE target NOT IN (SELECT path FROM f) GROUP BY ALL"


@query("join_doc_links", LINKS)
def join_doc_links(t):
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), 1)).alias("target"))
    files = t("documents").select(F.explode(F.split("text", " ")).alias("path"))
    return G.broken_links(links, files).groupBy("page_id", "target").agg(F.count("*").alias("n"))


TOKENS = """WITH k AS (SELECT doc_id AS path, generate_subscripts(w, 1) AS line, unnest(w) AS token FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), s AS (SELECT token, path, line FROM k WHERE line = 1),
u AS (SELECT DISTINCT k.* FROM k WHERE token IN (SELECT token FROM s) AND line > 1), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY path, line) AS rank FROM u) SELECT token, path, line, rank FROM r WHERE rank <= 80"""


@query("join_refs_tokens", TOKENS)
def join_refs_tokens(t):
    """The first token of every document is a symbol; its uses in all texts."""
    k = t("documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", " ")).alias("pos", "token")).select("path", (F.col("pos") + 1).alias("line"), "token")
    return G.references(k, k.filter("line = 1").select(F.col("token").alias("symbol"), "path", "line"))


@query("join_import_resolve", "WITH c AS (SELECT p_partkey AS ref_id, unnest(['m' || p_partkey % 90, 'm' || p_partkey % 90 || '.ts', 'm' || p_partkey % 90 || '/index.ts']) AS path, unnest([1, 2, 3]) AS prio FROM part), f AS (SELECT 'm' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.ts' ELSE '/index.ts' END AS path FROM part WHERE p_partkey < 80), m AS (SELECT ref_id, min_by(path, prio) AS resolved FROM c JOIN f USING (path) GROUP BY ref_id) SELECT p_partkey AS ref_id, resolved FROM part LEFT JOIN m ON ref_id = p_partkey")
def join_import_resolve(t):
    k = F.col("p_partkey")
    refs = t("part").select(k.alias("ref_id"), F.concat(F.lit("m"), (k % 90).cast("string")).alias("base"))
    files = t("part").filter("p_partkey < 80").select(F.concat(F.lit("m"), k.cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, ".ts").otherwise("/index.ts")).alias("path"))
    return G.resolve_first(refs, G.import_candidates(F.col("base")), files).select("ref_id", "resolved")





# --- traces -----------------------------------------------------------------------------------

MS = "CAST(epoch_us(ts) // 1000 AS BIGINT)"


def spans(t):
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return t("events").select(F.col("user_id"), F.col("event_id").alias("span_id"), start.alias("start_ms"), (start + F.floor("value").cast("long") * 1000).alias("end_ms"), "event_type")


@query("join_interval_window", f"""WITH s AS (SELECT user_id, event_id AS span_id, {MS} AS start_ms, {MS} + CAST(floor(value) AS BIGINT) * 1000 AS end_ms, event_type FROM events)
SELECT p.user_id, p.span_id AS point_id, s.span_id FROM s p JOIN s ON s.user_id = p.user_id AND s.end_ms >= p.start_ms - 1500 AND s.start_ms <= p.start_ms + 1500 WHERE p.event_type = 'error'""")
def join_interval_window(t):
    s = spans(t)
    points = s.filter("event_type = 'error'").select("user_id", F.col("span_id").alias("point_id"), F.col("start_ms").alias("at_ms"))
    return W.around(points, s.select("user_id", "span_id", "start_ms", "end_ms"), "user_id").select("user_id", "point_id", "span_id")


def network(t):
    i = F.col("event_id")
    return t("events").select(i.alias("call_id"), F.when(F.col("event_type") == "error", 500 + i % 3).when(i % 7 == 0, 404).otherwise(200).cast("int").alias("status"), (F.col("value") * 10).alias("duration_ms"))


NET = "n AS (SELECT event_id AS call_id, CASE WHEN event_type = 'error' THEN 500 + event_id % 3 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status, value * 10 AS duration_ms FROM events)"


@query("agg_network", f"WITH {NET} SELECT count(*) AS total, count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (status >= 500) AS server_errors, count(*) FILTER (duration_ms >= 1000) AS slow, max(duration_ms) AS slowest_ms FROM n")
def agg_network(t):
    return W.network_summary(network(t))


@query("topk_slow_calls", f"WITH {NET} SELECT * FROM n WHERE duration_ms >= 1000 ORDER BY duration_ms DESC, call_id LIMIT 10")
def topk_slow_calls(t):
    return W.slowest(network(t))


@query("agg_console", f"SELECT event_type AS type, count(*) AS n, min({MS}) AS first_ms FROM events GROUP BY 1")
def agg_console(t):
    return W.console_summary(t("events").select(F.col("event_type").alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")))


@query("set_merge_actions", "WITH r AS (SELECT l_orderkey AS call_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS api_name, CASE WHEN l_linenumber > 2 THEN l_linestatus END AS selector, l_quantity AS start_ms, l_extendedprice AS end_ms FROM lineitem) SELECT call_id, min_by(api_name, {'p': pos, 'v': api_name}) FILTER (api_name IS NOT NULL) AS api_name, min_by(selector, {'p': pos, 'v': selector}) FILTER (selector IS NOT NULL) AS selector, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(end_ms) - min(start_ms) AS duration_ms FROM r GROUP BY call_id")
def set_merge_actions(t):
    n = F.col("l_linenumber")
    rows = t("lineitem").select(F.col("l_orderkey").alias("call_id"), n.alias("pos"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("api_name"), F.when(n > 2, F.col("l_linestatus")).alias("selector"), F.lit(None).cast("string").alias("error"), F.col("l_quantity").alias("start_ms"), F.col("l_extendedprice").alias("end_ms"))
    return W.merge_actions(rows).drop("error")


# --- rasters ----------------------------------------------------------------------------------


def pixels(t, changed: bool):
    """One image of 64 x 64 a region, with a changed square."""
    x, y = F.col("id") % 64, F.floor(F.col("id") / 64)
    grid = t("region").select(F.col("r_name").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("id"))
    inside = x.between(10, 21) & y.between(10, 21) if changed else F.lit(False)
    return grid.select("image", x.cast("int").alias("x"), y.cast("int").alias("y"), F.when(inside, 200).otherwise(34).alias("r"), F.when(inside, 20).otherwise(48).alias("g"), F.lit(72).alias("b"))


GRID = "g AS (SELECT r_name AS image, CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y FROM region, range(0, 4096) t(i)), d AS (SELECT *, x BETWEEN 10 AND 21 AND y BETWEEN 10 AND 21 AS inside FROM g)"


@query("raster_pixel_diff", f"WITH {GRID} SELECT image, count(*) AS pixels, count(*) FILTER (inside) AS changed, floor(count(*) FILTER (inside) / count(*) * 100.0 * 1000.0 + 0.5) / 1000.0 AS changed_pct, count(*) FILTER (inside) / count(*) * 100.0 <= 0.1 AS passed FROM d WHERE NOT (x < 12 AND y < 12) GROUP BY image")
def raster_pixel_diff(t):
    masks = t("region").sparkSession.range(1).select(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(12).alias("x1"), F.lit(12).alias("y1"))
    return X.pixel_diff(pixels(t, False), pixels(t, True), masks)


@query("raster_changed_mask", f"WITH {GRID} SELECT image, x, y FROM d WHERE inside")
def raster_changed_mask(t):
    return X.changed_mask(pixels(t, False), pixels(t, True))


PICTURES = "SELECT n_nationkey AS k, x, y, (x * 9 + n_nationkey) % 256 AS r, (y * 7 + n_nationkey * 3) % 256 AS g, n_regionkey * 50 AS b FROM nation, (SELECT unnest(range(0, 32)) AS x) a, (SELECT unnest(range(0, 20)) AS y) c"


@query("src_image", f"SELECT 'n' || k AS image, x::INT AS x, y::INT AS y, r::INT AS r, g::INT AS g, b::INT AS b FROM ({PICTURES})")
def src_image(t):
    """A picture for each nation, written as files and read again."""
    k = F.col("n_nationkey")
    place = t("nation").select(F.concat(F.lit("n"), k.cast("string")).alias("image"), k, "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(639))).alias("i")).withColumns({"x": F.col("i") % 32, "y": F.floor(F.col("i") / 32).cast("int")})
    pixels = place.select("image", "x", "y", ((F.col("x") * 9 + k) % 256).cast("int").alias("r"), ((F.col("y") * 7 + k * 3) % 256).cast("int").alias("g"), (F.col("n_regionkey") * 50).cast("int").alias("b"))
    spark = place.sparkSession
    folder = scratch(spark)
    if IM.write_images(pixels, folder).filter("bytes > 0").isEmpty():
        return pixels.limit(0)
    return IM.read_pixels(spark, folder)


SHIPPED = "m AS (SELECT DISTINCT l_returnflag AS image, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))::INT AS x, l_quantity::INT AS y FROM lineitem)"


def shipped(t):
    """A raster for each flag: days across, quantities down, a pixel where something was shipped."""
    return t("lineitem").select(F.col("l_returnflag").alias("image"), F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).alias("x"), F.col("l_quantity").cast("int").alias("y"))


@query("raster_components", f"""WITH RECURSIVE {SHIPPED}, d(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), r(image, x, y, c) AS (SELECT image, x, y, x * 1000 + y FROM m UNION
SELECT m.image, m.x, m.y, r.c FROM r, d, m WHERE m.image = r.image AND m.x = r.x + dx AND m.y = r.y + dy), k AS (SELECT image, x, y, min(c) AS c FROM r GROUP BY ALL)
SELECT image, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels FROM k GROUP BY image, c HAVING count(*) >= 4""")
def raster_components(t):
    return X.components(shipped(t), 4, tile=64)


@query("topk_regions", f"SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS area, row_number() OVER (PARTITION BY image ORDER BY (x1 - x0 + 1) * (y1 - y0 + 1) DESC, pixels DESC, y0, x0) AS rank FROM ({SQL['raster_components']}) QUALIFY rank <= 8")
def topk_regions(t):
    return X.region_rank(X.components(shipped(t), 4, tile=64))


# --- receipts ---------------------------------------------------------------------------------


def receipts(t):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    h = lambda x: F.sha2(x.cast("string"), 256)
    return t("events").select(
        "event_id", "user_id", F.struct(
            F.lit("1").alias("schema_version"), F.struct(F.when(i % 10 == 0, "shout").otherwise("click").alias("type"), F.concat(F.lit('#é"'), F.col("event_type")).alias("selector"), F.lit(None).cast("string").alias("value")).alias("action"),
            F.struct(F.concat(F.lit("https://x.test/"), u).alias("url"), h(i % 3).alias("dom_region_hash")).alias("pre_state"),
            F.struct(F.when(i % 9 != 0, F.concat(F.lit("https://x.test/"), u)).alias("url"), h(i % 2).alias("dom_region_hash"), (i % 2 == 0).alias("changed"), F.lit(True).alias("stable"), F.lit(False).alias("navigated")).alias("post_state"),
            F.struct(F.array(F.lit("a"), F.lit("b")).alias("console"), F.array().cast("array<string>").alias("network"), F.lit(False).alias("selector_not_found"), F.lit(False).alias("timeout"), F.lit(None).cast("string").alias("action_failed")).alias("errors"),
        ).alias("receipt"),
    )


CANON = """c AS (SELECT event_id, user_id, '{"action": {"selector": "#é\\"' || event_type || '", "type": "' || CASE WHEN event_id % 10 = 0 THEN 'shout' ELSE 'click' END || '", "value": null}, "errors": {"action_failed": null, "console": ["a", "b"], "network": [], "selector_not_found": false, "timeout": false}, "post_state": {"changed": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "dom_region_hash": "' || sha256(CAST(event_id % 2 AS VARCHAR)) || '", "navigated": false, "stable": true, "url": ' || CASE WHEN event_id % 9 <> 0 THEN '"https://x.test/' || user_id || '"' ELSE 'null' END || '}, "pre_state": {"dom_region_hash": "' || sha256(CAST(event_id % 3 AS VARCHAR)) || '", "url": "https://x.test/' || user_id || '"}, "schema_version": "1"}' AS j FROM events)"""


@query("fn_canonical_json", f"WITH {CANON} SELECT event_id, sha256(j) AS digest FROM c")
def fn_canonical_json(t):
    return receipts(t).select("event_id", F.sha2(A.canonical_json(), 256).alias("digest"))


@query("fn_validate_receipt", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 9 = 0 THEN 'missing post_state.url' END, CASE WHEN event_id % 10 = 0 THEN 'unknown action shout' END], lambda x: x IS NOT NULL), ';') AS problems FROM events")
def fn_validate_receipt(t):
    return receipts(t).select("event_id", F.array_join(A.problems(), ";").alias("problems"))


@query("agg_modal_score", f"WITH {CANON}, p AS (SELECT user_id, sha256(j) AS digest, count(*) AS n FROM c GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS runs, max(n) / sum(n) AS score FROM p GROUP BY user_id")
def agg_modal_score(t):
    return A.modal_share(receipts(t).select("user_id", F.sha2(A.canonical_json(), 256).alias("digest")), ["user_id"], "digest")


@query("agg_selector_miss", "SELECT user_id, count(*) AS runs, max(floor(value))::BIGINT AS largest, count(DISTINCT event_type) AS hashes, max(floor(value)) < 200 AS selector_miss, count(*) >= 3 AND count(DISTINCT event_type) = 1 AS constant_hash FROM events GROUP BY user_id")
def agg_selector_miss(t):
    rows = t("events").select("user_id", F.floor("value").alias("size_bytes"), F.col("event_type").alias("hash"))
    return A.suspicious(rows, ["user_id"])


@query("fn_dom_hash", "SELECT page_id, 'sha256:' || sha256(html) AS dom_hash FROM pages")
def fn_dom_hash(t):
    with_noise = F.regexp_replace("html", "<article>", '<article data-time="12" data-frame="x">')
    return t("pages").select("page_id", A.dom_hash(with_noise).alias("dom_hash"))
