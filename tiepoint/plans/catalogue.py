"""The registered queries of the engine's operators on the test tables, each with its SQL twin where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.functions import classify, geometry, labels
from tiepoint.operators import descriptors, drawing, matches, pairing, points, quantiles, ransac, raster, refine, summary, suppression, tiles
from tiepoint.plans import bridge
from tiepoint.plans.bridge import HEIGHT, SHIFT, WIDTH, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


_WITH = lambda *names: "WITH " + ", ".join(bridge.sql(n) for n in names)
_ERRORS = "errors AS (SELECT *, source_x + 23 AS predicted_x, source_y - 14 AS predicted_y, sqrt((source_x + 23 - reference_x) ** 2 + (source_y - 14 - reference_y) ** 2) AS error FROM corr)"
_CELLS = f"cells AS (SELECT *, least(cast(trunc(reference_y * 8 / {HEIGHT}) AS int), 7) AS \"row\", least(cast(trunc(reference_x * 8 / {WIDTH}) AS int), 7) AS col FROM corr WHERE reference_x >= 0 AND reference_x < {WIDTH} AND reference_y >= 0 AND reference_y < {HEIGHT})"


def _with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.residuals(view(spark, sf_dir, "corr"), SHIFT)


@query(f"{_WITH('corr')}, {_CELLS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id, \"row\", col ORDER BY confidence DESC, match_id) AS nth FROM cells WHERE inlier) SELECT pair_id, match_id, \"row\", col, confidence, row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, match_id) AS rank FROM ranked WHERE nth <= 2")
def uniform_selection(spark, sf_dir):
    found = matches.select_uniform(view(spark, sf_dir, "corr"), WIDTH, HEIGHT, max_per_cell=2)
    return found.select("pair_id", "match_id", "row", "col", "confidence", "rank")


@query(f"{_WITH('corr')}, {_ERRORS} SELECT pair_id, count(*) AS point_count, round(sqrt(avg(error * error)), 6) AS rmse_px, round(median(error), 6) AS median_px, round(quantile_cont(error, 0.95), 6) AS p95_px, round(max(error), 6) AS max_px FROM errors GROUP BY 1")
def tie_point_report(spark, sf_dir):
    found = points.error_report(points.point_errors(view(spark, sf_dir, "corr"), SHIFT), ["pair_id"])
    return found.withColumns(r6("rmse_px", "median_px", "p95_px", "max_px"))


@query(f"{_WITH('corr')}, {_ERRORS} SELECT pair_id, match_id, round(predicted_x, 6) AS predicted_x, round(predicted_y, 6) AS predicted_y, round(error, 6) AS error_px FROM errors")
def tie_point_detail(spark, sf_dir):
    return points.point_errors(view(spark, sf_dir, "corr"), SHIFT).select("pair_id", "match_id", "predicted_x", "predicted_y", "error_px").withColumns(r6("predicted_x", "predicted_y", "error_px"))


@query("""WITH p AS (SELECT trim(concat(' t', cast(c_custkey % 1400 AS varchar), ' ')) AS id, c_acctbal AS source_x, abs(c_acctbal) AS source_y FROM customer)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated id' WHEN source_x < 0 THEN 'source_x is negative' END AS problem FROM p""")
def tie_point_validation(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(F.concat(F.lit(" t"), (F.col("c_custkey") % 1400).cast("string"), F.lit(" ")).alias("id"), F.col("c_acctbal").alias("source_x"), F.abs("c_acctbal").alias("source_y"), F.lit(1.0).alias("reference_x"), F.lit(2.0).alias("reference_y"))
    return points.check_points(rows, most=10**12).select("id", "problem")


@query(f"{_WITH('corr')}, {_ERRORS}, e AS (SELECT *, CASE WHEN inlier THEN error END AS ie FROM errors) SELECT pair_id, count(*) AS valid_matches, count(*) FILTER (inlier) AS inliers, round(avg(inlier::INT::DOUBLE), 6) AS inlier_ratio, round(sqrt(avg(ie * ie)), 6) AS residual_rmse_px, round(median(ie), 6) AS residual_median_px, round(quantile_cont(ie, 0.95), 6) AS residual_p95_px FROM e GROUP BY 1")
def registration_metrics(spark, sf_dir):
    return matches.registration_metrics(_with_errors(spark, sf_dir)).withColumns(r6("inlier_ratio", "residual_rmse_px", "residual_median_px", "residual_p95_px"))


@query(f"{_WITH('corr')}, {_CELLS}, n AS (SELECT pair_id, \"row\", col, count(*) AS n FROM cells WHERE inlier GROUP BY 1, 2, 3), g AS (SELECT * FROM (SELECT DISTINCT pair_id FROM corr), range(8) a(\"row\"), range(8) b(col)), f AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (pair_id, \"row\", col)) SELECT pair_id, count(*) FILTER (n > 0) AS occupied_cells, round(count(*) FILTER (n > 0) / 64.0::DOUBLE, 6) AS spatial_coverage, round(var_pop(n), 6) AS distribution_variance, array_to_string(list(n ORDER BY \"row\", col), ',') AS matches_per_cell FROM f GROUP BY 1")
def grid_coverage(spark, sf_dir):
    found = matches.coverage(view(spark, sf_dir, "corr"), WIDTH, HEIGHT).withColumns(r6("spatial_coverage", "distribution_variance"))
    return found.withColumn("matches_per_cell", F.array_join(F.col("matches_per_cell").cast("array<string>"), ","))


@query(f"{_WITH('corr')}, b AS (SELECT *, 0 AS kind FROM (SELECT * REPLACE (least(greatest(confidence / 0.25, 0), 1) AS confidence) FROM corr WHERE match_id % 2 = 0) UNION ALL SELECT * REPLACE (match_id // 2 * 2 AS match_id), 1 FROM (SELECT * REPLACE (source_x + 0.25 AS source_x) FROM corr WHERE match_id % 3 = 0)), k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, round_even(source_x / 2, 0), round_even(source_y / 2, 0), round_even(reference_x / 2, 0), round_even(reference_y / 2, 0) ORDER BY confidence DESC, kind, match_id) AS nth FROM b WHERE confidence >= 0.05) SELECT pair_id, match_id, kind, confidence FROM k WHERE nth = 1")
def fusion_dedupe(spark, sf_dir):
    c = view(spark, sf_dir, "corr")
    learned = c.where("match_id % 3 = 0").withColumn("source_x", F.col("source_x") + 0.25).withColumn("match_id", F.expr("match_id div 2 * 2"))
    return matches.fuse(c.where("match_id % 2 = 0"), learned).select("pair_id", "match_id", "kind", "confidence")


@query(f"{_WITH('corr')}, {_CELLS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id, \"row\", col ORDER BY confidence DESC, match_id) AS nth FROM cells WHERE inlier) SELECT c.pair_id, c.match_id, r.match_id IS NOT NULL AS selected FROM corr c LEFT JOIN (SELECT * FROM ranked WHERE nth <= 2) r ON c.pair_id = r.pair_id AND c.match_id = r.match_id")
def selected_flags(spark, sf_dir):
    c = view(spark, sf_dir, "corr")
    return matches.flag_selected(c, matches.select_uniform(c, WIDTH, HEIGHT, max_per_cell=2)).select("pair_id", "match_id", "selected")


@query(f"{_WITH('corr')}, {_ERRORS} SELECT pair_id, match_id, cast(trunc(greatest(0, 255 - error * 50)) AS int) AS error_green, cast(trunc(least(255, error * 50)) AS int) AS error_red, cast(trunc(255 * confidence) AS int) AS confidence_green, cast(trunc(255 * (1 - confidence)) AS int) AS confidence_red, cast(round_even(reference_x, 0) AS int) AS marker_x, cast(round_even(reference_y, 0) AS int) AS marker_y FROM errors")
def marker_maps(spark, sf_dir):
    return matches.marker_colours(_with_errors(spark, sf_dir)).select("pair_id", "match_id", "error_green", "error_red", "confidence_green", "confidence_red", "marker_x", "marker_y")


@query(f"{_WITH('corr')}, d AS (SELECT pair_id, match_id, (reference_x - 300) ** 2 + (reference_y - 200) ** 2 AS d2 FROM corr), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY d2, match_id) AS nth FROM d WHERE d2 < 2500) SELECT pair_id, match_id, round(d2, 6) AS d2 FROM r WHERE nth = 1")
def nearest_point(spark, sf_dir):
    return points.nearest_to(view(spark, sf_dir, "corr"), 300.0, 200.0, 50.0, ["pair_id"]).withColumns(r6("d2"))


@query(f"{_WITH('corr')} SELECT pair_id, match_id, confidence FROM corr WHERE inlier AND confidence >= 0.7")
def confident_matches(spark, sf_dir):
    return matches.visible(view(spark, sf_dir, "corr"), "confident").select("pair_id", "match_id", "confidence")


_EVEN_ODD = "a AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 2 = 1)"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY distance, reference_id) AS nth FROM d), w AS (SELECT source_id, max(reference_id) FILTER (nth = 1) AS reference_id, max(distance) FILTER (nth = 1) AS distance, max(distance) FILTER (nth = 2) AS second_distance FROM r WHERE nth <= 2 GROUP BY 1)"


@query(f"WITH {_EVEN_ODD}, d AS (SELECT a.vec_id AS source_id, b.vec_id AS reference_id, list_distance(a.e::DOUBLE[], b.e::DOUBLE[]) AS distance FROM a, b), {_RANKED} SELECT '0' AS pair_id, source_id, reference_id, round(distance, 6) AS distance, round(second_distance, 6) AS second_distance, round(greatest(0, 1 - distance / greatest(second_distance, 1e-9)), 6) AS confidence FROM w WHERE distance < 0.95 * second_distance")
def knn_ratio_match(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("0").alias("pair_id"), F.col("vec_id").alias("kp_id"), F.col("embedding").cast("array<double>").alias("desc"))
    found = descriptors.match(e.where("kp_id % 2 = 0"), e.where("kp_id % 2 = 1"), ratio=0.95)
    return found.select("pair_id", "source_id", "reference_id", "distance", "second_distance", "confidence").withColumns(r6("distance", "second_distance", "confidence"))


@query(f"WITH {_EVEN_ODD}, d AS (SELECT a.vec_id AS source_id, b.vec_id AS reference_id, len(list_filter(range(1, 65), lambda i: (a.e[i] > 0) <> (b.e[i] > 0)))::DOUBLE AS distance FROM a, b), {_RANKED} SELECT '0' AS pair_id, source_id, reference_id, distance, second_distance FROM w WHERE distance < 0.9 * second_distance")
def hamming_knn(spark, sf_dir):
    word = F.aggregate(F.transform("embedding", lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("0").alias("pair_id"), F.col("vec_id").alias("kp_id"), F.array(word).alias("desc"))
    found = descriptors.match(e.where("kp_id % 2 = 0"), e.where("kp_id % 2 = 1"), ratio=0.9, binary=True)
    return found.select("pair_id", "source_id", "reference_id", "distance", "second_distance")


@query(f"""{_WITH('browse').replace('WITH', 'WITH RECURSIVE')}, s AS (SELECT 'fn' AS pair_type, 'f' AS v UNION ALL SELECT 'an', 'a'),
e AS (SELECT cast(a.start AS date) AS date, a.variant, s.pair_type, a.member AS source_member, b.member AS reference_member, abs(epoch_us(a.start) - epoch_us(b.start)) / 1e6 AS delta
  FROM s JOIN browse a ON a.sensor_view = s.v JOIN browse b ON b.sensor_view = 'n' AND cast(a.start AS date) = cast(b.start AS date) AND a.variant = b.variant AND abs(epoch_us(a.start) - epoch_us(b.start)) <= 600000000),
n AS (SELECT *, row_number() OVER (PARTITION BY date, variant, pair_type ORDER BY delta, source_member, reference_member) AS k FROM e),
r AS (SELECT DISTINCT date, variant, pair_type, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS source_member, NULL::VARCHAR AS reference_member, NULL::DOUBLE AS delta FROM n
  UNION ALL SELECT n.date, n.variant, n.pair_type, n.k, CASE WHEN list_contains(used, 's' || n.source_member) OR list_contains(used, 'r' || n.reference_member) THEN used ELSE list_concat(used, ['s' || n.source_member, 'r' || n.reference_member]) END,
    CASE WHEN NOT (list_contains(used, 's' || n.source_member) OR list_contains(used, 'r' || n.reference_member)) THEN n.source_member END, n.reference_member, n.delta
  FROM r JOIN n ON n.date = r.date AND n.variant = r.variant AND n.pair_type = r.pair_type AND n.k = r.k + 1)
SELECT pair_type, source_member, reference_member, round(delta, 6) AS delta FROM r WHERE source_member IS NOT NULL""")
def pair_nearest_unique(spark, sf_dir):
    return pairing.pair_views(view(spark, sf_dir, "browse"), 600.0).select("pair_type", "source_member", "reference_member", "delta").withColumns(r6("delta"))


@query(f"""{_WITH('browse')}, g AS (SELECT event_id AS grid_id, CASE event_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'n' ELSE 'a' END AS v, ts FROM events WHERE event_type NOT IN ('click', 'view', 'purchase'))
SELECT grid_id, coalesce(array_to_string(list(member ORDER BY member) FILTER (member IS NOT NULL), ','), '') AS members, count(member)::INT AS found FROM g LEFT JOIN browse b ON b.sensor_view = g.v AND cast(b.start AS date) = cast(g.ts AS date) AND abs(epoch_us(b.start) - epoch_us(g.ts)) <= 300000000 GROUP BY 1""")
def geolocation_index(spark, sf_dir):
    return _grids(spark, sf_dir).select("grid_id", F.array_join("members", ",").alias("members"), "found")


def _grids(spark, sf_dir, named=True):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type NOT IN ('click', 'view', 'purchase')")
    grids = e.select(F.col("event_id").alias("grid_id"), F.expr("CASE event_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'n' ELSE 'a' END").alias("view"), F.col("ts").cast("timestamp").alias("start"), (F.col("user_id") % 50).alias("records"), F.concat(F.lit("geo_"), (F.col("event_id") % 4).cast("string")).alias("archive"))
    return pairing.within(view(spark, sf_dir, "browse"), grids, 300.0, named)


@query(f"""{_WITH('browse')}, g AS (SELECT event_id AS grid_id, CASE event_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'n' ELSE 'a' END AS v, ts, user_id % 50 AS records, concat('geo_', cast(event_id % 4 AS varchar)) AS archive FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')),
f AS (SELECT grid_id, any_value(records) AS records, any_value(archive) AS archive, count(member) AS found FROM g LEFT JOIN browse b ON b.sensor_view = g.v AND cast(b.start AS date) = cast(g.ts AS date) AND abs(epoch_us(b.start) - epoch_us(g.ts)) <= 300000000 GROUP BY 1)
SELECT count(*) AS grids, count(*) FILTER (found > 0) AS grids_with_products, coalesce(sum(records), 0)::BIGINT AS declared_records, array_to_string(list_sort(list(DISTINCT archive)), ',') AS archives FROM f""")
def geolocation_totals(spark, sf_dir):
    return summary.geolocation_totals(_grids(spark, sf_dir, named=False)).withColumn("archives", F.array_join("archives", ","))


@query(f"{_WITH('metric')} SELECT year::INT AS year, data_level, pair_type, count(*) AS pairs_attempted, count(*) FILTER (status = 'completed') AS pairs_completed, round(count(*) FILTER (status = 'completed') / count(*), 6) AS success_rate, round(median(inliers) FILTER (status = 'completed'), 6) AS median_inliers, round(median(inlier_ratio) FILTER (status = 'completed'), 6) AS median_inlier_ratio, round(median(residual_rmse_px) FILTER (status = 'completed'), 6) AS median_residual_rmse_px, round(median(selected_coverage) FILTER (status = 'completed'), 6) AS median_selected_coverage FROM metric GROUP BY 1, 2, 3")
def batch_summary(spark, sf_dir):
    return summary.batch_summary(view(spark, sf_dir, "metric")).withColumns(r6("success_rate", "median_inliers", "median_inlier_ratio", "median_residual_rmse_px", "median_selected_coverage"))


@query(f"{_WITH('metric')} SELECT count(*) AS pairs_total, count(*) FILTER (status = 'completed') AS pairs_completed, count(*) FILTER (status = 'failed') AS pairs_failed FROM metric")
def status_counts(spark, sf_dir):
    return summary.status_counts(view(spark, sf_dir, "metric"))


@query(f"{_WITH('metric')}, again AS (SELECT pair_id, source_member, reference_member, 'completed' AS status, inliers + 1 AS inliers FROM metric WHERE status = 'failed') SELECT pair_id, source_member, reference_member, status, inliers, year FROM metric WHERE (source_member, reference_member) NOT IN (SELECT (source_member, reference_member) FROM again) UNION ALL SELECT pair_id, source_member, reference_member, status, inliers, NULL FROM again")
def retry_merge(spark, sf_dir):
    m = view(spark, sf_dir, "metric")
    pairs = m.select(F.concat(F.lit("new_"), "source_member").alias("pair_id"), "source_member", "reference_member", "inliers")
    again = pairing.reuse_ids(pairing.to_retry(pairs, m), m).select("pair_id", "source_member", "reference_member", F.lit("completed").alias("status"), (F.col("inliers") + 1).alias("inliers"))
    return pairing.merge_retried(m, again).select("pair_id", "source_member", "reference_member", "status", "inliers", "year")


@query(f"{_WITH('metric')} SELECT pair_id, data_level, pair_type FROM metric WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY data_level, pair_type ORDER BY pair_id) <= 3")
def exemplar_first_n(spark, sf_dir):
    return pairing.first_n(view(spark, sf_dir, "metric").where("status = 'completed'"), ["data_level", "pair_type"], 3).select("pair_id", "data_level", "pair_type")


@query("SELECT o_orderkey, concat('tmc2_', o_orderpriority, '_', printf('%05d', row_number() OVER (ORDER BY o_orderdate, o_orderkey))) AS pair_id FROM orders")
def pair_ids(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return pairing.number_pairs(o, ["o_orderdate", "o_orderkey"], F.concat(F.lit("tmc2_"), "o_orderpriority")).select("o_orderkey", "pair_id")


@query("SELECT n_name AS pair, r_name AS method FROM nation, region")
def experiment_matrix(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return pairing.experiment_matrix(read("nation").select(F.col("n_name").alias("pair")), read("region").select(F.col("r_name").alias("method")))


def _pattern_cases(patterns: dict, text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{s}'" for s, p in patterns.items()) + " END"


_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(path), '{p}') THEN '{s}' END" for s, p in classify.PATH_PATTERNS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {bridge.paths_sql()}, h AS (SELECT path, {_HITS} AS hits, contains(lower(path), 'synthetic') OR list_contains(string_split(path, '/'), 'sample') AS syn FROM paths) SELECT path, CASE WHEN NOT syn AND len(hits) = 1 THEN hits[1] ELSE 'UNKNOWN' END AS sensor, CASE WHEN NOT syn AND len(hits) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN syn THEN 'synthetic' WHEN len(hits) = 1 THEN 'product identifier' WHEN len(hits) > 1 THEN 'conflicting identifiers' ELSE 'no identifier' END AS evidence FROM h")
def classify_sensor(spark, sf_dir):
    return bridge.paths(spark, sf_dir).select("path", classify.sensor_of_path(F.col("path")).alias("s")).select("path", "s.*")


@query(f"WITH {bridge.paths_sql()} SELECT path, {_pattern_cases(classify.ARCHIVE_PATTERNS, 'lower(path)')} AS sensor FROM paths")
def classify_archive(spark, sf_dir):
    return bridge.paths(spark, sf_dir).select("path", classify.sensor_of_archive(F.col("path"), F.array().cast("array<string>")).alias("sensor"))


@query(f"WITH {bridge.paths_sql()} SELECT path, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(path), '{x}')" for x in parts) + f" THEN '{s}'" for s, parts in classify.INVENTORY_PARTS.items()) + " END AS sensor FROM paths")
def classify_inventory(spark, sf_dir):
    return bridge.paths(spark, sf_dir).select("path", classify.sensor_of_file(F.col("path")).alias("sensor"))


@query(f"WITH {bridge.paths_sql()} SELECT path, CASE " + " ".join(f"WHEN list_contains(string_split(lower(path), '/'), '{x}') THEN '{x}'" for x in classify.LEVELS) + " ELSE 'unknown' END AS data_level FROM paths")
def data_level(spark, sf_dir):
    return bridge.paths(spark, sf_dir).select("path", classify.data_level(F.array("path")).alias("data_level"))


@query(f"WITH {bridge.paths_sql()} SELECT path, NOT (contains(path, '\\') OR starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(string_split(path, '/'), '..')) AS safe, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM paths")
def path_safety(spark, sf_dir):
    return bridge.paths(spark, sf_dir).select("path", classify.is_safe_member(F.col("path")).alias("safe"), classify.suffix(F.col("path")).alias("suffix"))


_SUFFIX = "lower(regexp_extract(member, '[^/](\\.[^./]+)$', 1))"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"""{_WITH('members')}, m AS (SELECT *, {_SUFFIX} AS suffix, list_slice(string_split(member, '/'), 1, len(string_split(member, '/')) - 1) AS folders FROM members),
g AS (SELECT archive, count(*) AS member_count, sum(size)::BIGINT AS uncompressed_bytes, count(*) FILTER (suffix IN {_IN(classify.IMAGE_SUFFIXES)}) AS image_members, count(*) FILTER (suffix = '.xml') AS xml_labels, bool_or(len(list_filter(folders, lambda f: lower(f) = 'data')) > 0) AS has_data_directory, array_to_string(list_sort(list_distinct(flatten(list(folders)))), ',') AS directories, list(member ORDER BY member) AS names FROM m GROUP BY 1)
SELECT * EXCLUDE (names), {_pattern_cases(classify.ARCHIVE_PATTERNS, "lower(archive || ' ' || array_to_string(names[1:100], ' '))")} AS sensor,
  CASE {" ".join(f"WHEN list_contains(flatten(list_transform(names, lambda n: string_split(lower(n), '/'))), '{x}') THEN '{x}'" for x in classify.LEVELS)} ELSE 'unknown' END AS data_level FROM g""")
def archive_rollup(spark, sf_dir):
    return summary.archive_rollup(view(spark, sf_dir, "members")).withColumn("directories", F.array_join("directories", ","))


_INVENTORY_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(path), '{x}')" for x in parts) + f" THEN '{s}'" for s, parts in classify.INVENTORY_PARTS.items()) + " END"


@query(f"""{_WITH('members')}, a AS (SELECT archive AS path, member, archive NOT LIKE '%7.zip' AS valid FROM members),
p AS (SELECT path, bool_and(valid) AS valid, count(*) FILTER ({_SUFFIX} IN {_IN(classify.SCIENCE_SUFFIXES)}) AS science, count(*) FILTER ({_SUFFIX} IN {_IN(classify.QUICKLOOK_SUFFIXES)}) AS quick FROM a GROUP BY 1),
o AS (SELECT {_INVENTORY_CASE} AS sensor, count(*) FILTER (valid) AS archives, count(*) FILTER (valid AND science > 0) AS archives_with_science, sum(science) FILTER (valid) AS science_members, sum(quick) FILTER (valid) AS quicklook_members, count(*) FILTER (NOT valid) AS invalid_archives FROM p GROUP BY 1),
f AS (SELECT CASE page_id % 4 WHEN 0 THEN concat('raw/ohrc/', page_id, '.zip.part') WHEN 1 THEN concat('stage/raw/IIRS/p', page_id, '/product_manifest.json') WHEN 2 THEN concat('tmc_', page_id, '.part') ELSE concat('x/', page_id) END AS path FROM pages),
c AS (SELECT CASE WHEN path LIKE '%.part' THEN {_INVENTORY_CASE} WHEN contains(path, '/OHRC/') THEN 'OHRC' WHEN contains(path, '/TMC-2/') THEN 'TMC-2' WHEN contains(path, '/IIRS/') THEN 'IIRS' END AS sensor, path FROM f WHERE path LIKE '%.part' OR path LIKE '%\\_manifest.json' ESCAPE '\\'),
d AS (SELECT sensor, count(*) FILTER (path LIKE '%.part') AS incomplete_downloads, count(*) FILTER (path LIKE '%.json') AS staged_products FROM c GROUP BY 1)
SELECT s.sensor, coalesce(archives, 0)::BIGINT AS archives, coalesce(archives_with_science, 0)::BIGINT AS archives_with_science, coalesce(science_members, 0)::BIGINT AS science_members, coalesce(quicklook_members, 0)::BIGINT AS quicklook_members, coalesce(invalid_archives, 0)::BIGINT AS invalid_archives, coalesce(incomplete_downloads, 0)::BIGINT AS incomplete_downloads, coalesce(staged_products, 0)::BIGINT AS staged_products
FROM (VALUES ('OHRC'), ('TMC-2'), ('IIRS')) s(sensor) LEFT JOIN o ON o.sensor = s.sensor LEFT JOIN d ON d.sensor = s.sensor""")
def sensor_inventory(spark, sf_dir):
    m = view(spark, sf_dir, "members").select(F.col("archive").alias("path"), "member", (~F.col("archive").endswith("7.zip")).alias("valid"))
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("CASE page_id % 4 WHEN 0 THEN concat('raw/ohrc/', page_id, '.zip.part') WHEN 1 THEN concat('stage/raw/IIRS/p', page_id, '/product_manifest.json') WHEN 2 THEN concat('tmc_', page_id, '.part') ELSE concat('x/', page_id) END AS path")
    return summary.sensor_inventory(m, files)


@query(f"{_WITH('raster')}, l AS (SELECT product_id, quantile_cont(v, 0.01) FILTER (valid) AS lo, quantile_cont(v, 0.99) FILTER (valid) AS hi FROM raster GROUP BY 1) SELECT product_id, y, x, CASE WHEN valid THEN cast(trunc(least(greatest((v - lo) * 255 / (hi - lo), 0), 255)) AS int) ELSE 0 END AS gray FROM raster JOIN l USING (product_id)")
def percentile_stretch(spark, sf_dir):
    return raster.stretch(view(spark, sf_dir, "raster")).select("product_id", "y", "x", "gray")


@query(f"{_WITH('raster')}, l AS (SELECT product_id, quantile_cont(v, 0.05) FILTER (valid) AS q FROM raster GROUP BY 1) SELECT product_id, y, x, valid AND v > q AS lit FROM raster JOIN l USING (product_id)")
def shadow_mask(spark, sf_dir):
    return raster.shadow_mask(view(spark, sf_dir, "raster")).select("product_id", "y", "x", "lit")


@query(f"{_WITH('raster')} SELECT product_id, round(avg(valid::INT), 6) AS valid_fraction FROM raster GROUP BY 1")
def valid_fraction(spark, sf_dir):
    return raster.valid_fraction(view(spark, sf_dir, "raster")).withColumns(r6("valid_fraction"))


def _reflected(reach: int) -> str:
    """Every place with its neighbours up to ``reach``, edges mirrored."""
    m = lambda a, d: f"CASE WHEN {a} + {d} < 0 THEN -({a} + {d}) WHEN {a} + {d} > 63 THEN 126 - ({a} + {d}) ELSE {a} + {d} END"
    return f"n AS (SELECT p.product_id, p.y, p.x, dy, dx, q.v FROM raster p, range(-{reach}, {reach + 1}) a(dy), range(-{reach}, {reach + 1}) b(dx) JOIN raster q ON q.product_id = p.product_id AND q.y = {m('p.y', 'dy')} AND q.x = {m('p.x', 'dx')})"


_SOBEL = f"{_WITH('raster')}, {_reflected(1)}, g AS (SELECT product_id, y, x, sqrt(sum(v * dx * (2 - abs(dy))) ** 2 + sum(v * dy * (2 - abs(dx))) ** 2) AS magnitude FROM n GROUP BY 1, 2, 3)"


@query(f"{_SOBEL}, t AS (SELECT product_id, quantile_cont(magnitude, 0.99) AS top FROM g GROUP BY 1) SELECT product_id, y, x, round(magnitude, 4) AS magnitude, cast(trunc(least(magnitude * 255 / top + 1e-9, 255)) AS int) AS gradient FROM g JOIN t USING (product_id)")
def sobel_gradient(spark, sf_dir):
    found = raster.sobel(view(spark, sf_dir, "raster"))
    top = found.groupBy("product_id").agg(F.percentile("magnitude", 0.99).alias("top"))
    # the exact quotient may fall on a whole number; both engines step over it alike
    gradient = F.least(F.col("magnitude") * 255 / F.col("top") + 1e-9, F.lit(255.0)).cast("int")
    return found.join(top, "product_id").select("product_id", "y", "x", F.round("magnitude", 4).alias("magnitude"), gradient.alias("gradient"))


@query(f"{_SOBEL} SELECT product_id, y, x, round(magnitude, 2) AS magnitude FROM g")
def sobel_tiles(spark, sf_dir):
    t = tiles.from_pixels(view(spark, sf_dir, "raster"), 24)
    return tiles.to_pixels(tiles.sobel_magnitude(t, 24), 24).select("product_id", "y", "x", F.round(F.col("v").cast("double"), 2).alias("magnitude"))


def _gauss_sql(sigma: float) -> str:
    w = raster.gaussian(sigma)
    r = len(w) // 2
    values = ", ".join(f"({i - r}, {x!r})" for i, x in enumerate(w))
    m = lambda a, d: f"CASE WHEN {a} + {d} < 0 THEN -({a} + {d}) WHEN {a} + {d} > 63 THEN 126 - ({a} + {d}) ELSE {a} + {d} END"
    return f"""w(d, k) AS (VALUES {values}),
    ax AS (SELECT p.product_id, p.y, p.x, sum(q.v * k) AS s, sum(q.v * q.v * k) AS s2 FROM raster p, w JOIN raster q ON q.product_id = p.product_id AND q.y = p.y AND q.x = {m('p.x', 'd')} GROUP BY 1, 2, 3),
    ay AS (SELECT p.product_id, p.y, p.x, sum(q.s * k) AS mean, sum(q.s2 * k) AS square FROM raster p, w JOIN ax q ON q.product_id = p.product_id AND q.x = p.x AND q.y = {m('p.y', 'd')} GROUP BY 1, 2, 3)"""


@query(f"{_WITH('raster')}, {_gauss_sql(2.0)} SELECT product_id, y, x, round(least(greatest((v - mean) / sqrt(greatest(square - mean * mean, 0) + 1) * 38 + 127, 0), 255), 3) AS normal FROM raster JOIN ay USING (product_id, y, x)")
def local_normalize(spark, sf_dir):
    return raster.local_normalise(view(spark, sf_dir, "raster"), 2.0).select("product_id", "y", "x", F.round("level", 3).alias("normal"))


@query(f"{_WITH('raster')}, {_reflected(2)}, k(d, w) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) SELECT product_id, y // 2 AS y, x // 2 AS x, cast(floor(sum(v * a.w * b.w) / 256 + 0.5) AS int) AS v FROM n JOIN k a ON a.d = dy JOIN k b ON b.d = dx WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY 1, 2, 3")
def pyramid_down(spark, sf_dir):
    return raster.pyramid_down(view(spark, sf_dir, "raster")).select("product_id", "y", "x", "v")


_SPECTRA = "s AS (SELECT concat('l', cast(label AS varchar)) AS product_id, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"WITH {_SPECTRA}, t AS (SELECT product_id, i - 1 AS i, j - 1 AS j, e[i] AS a, e[j] AS b FROM s, range(1, 65) p(i), range(1, 65) q(j) WHERE i <= j) SELECT product_id, i::INT AS i, j::INT AS j, round(avg(a), 6) AS mean_i, round(avg(b), 6) AS mean_j, round(covar_pop(a, b), 6) AS covariance FROM t GROUP BY 1, 2, 3")
def pca_moments(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("product_id"), F.col("embedding").cast("array<double>").alias("spectrum"))
    return raster.spectral_moments(e).withColumns(r6("mean_i", "mean_j", "covariance"))


@query()
def pca_plane(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("product_id"), F.col("vec_id").cast("int").alias("y"), F.lit(0).alias("x"), F.col("embedding").cast("array<double>").alias("spectrum"), (F.col("vec_id") % 17 != 0).alias("valid"))
    return raster.principal_plane(e).select("product_id", "y", F.round("v", 5).alias("v"), "valid")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS nth, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE nth IN (SELECT 0) OR (nth, n) IN (SELECT (cast(floor(i * (n - 1) / (least(n, 100) - 1)) AS bigint), n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority), range(100) r(i) WHERE i < least(n, 100))")
def systematic_sample(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return raster.systematic_sample(o, ["o_orderkey"], 100, ["o_orderpriority"]).select("o_orderkey")


_GENERAL = (1.01, 0.02, 3.0, -0.015, 0.99, -2.0, 0.00001, 0.00002, 1.0)


@query(f"{_WITH('corr')}, p AS (SELECT *, 0.00001 * source_x + 0.00002 * source_y + 1 AS w FROM corr) SELECT pair_id, match_id, round((1.01 * source_x + 0.02 * source_y + 3) / w, 6) AS px, round((-0.015 * source_x + 0.99 * source_y - 2) / w, 6) AS py FROM p".replace("0.00001 ", "0.00001::DOUBLE ").replace("0.00002 ", "0.00002::DOUBLE ").replace("1.01 ", "1.01::DOUBLE ").replace("0.02 ", "0.02::DOUBLE ").replace("-0.015 ", "-0.015::DOUBLE ").replace("0.99 ", "0.99::DOUBLE "))
def project_points(spark, sf_dir):
    x, y = geometry.project(F.col("source_x"), F.col("source_y"), _GENERAL)
    return view(spark, sf_dir, "corr").select("pair_id", "match_id", x.alias("px"), y.alias("py")).withColumns(r6("px", "py"))


@query("SELECT n_nationkey, round(5e0 + 300 + n_nationkey - 100, 6) AS m2, round(-3e0 + 400 - (200 + n_nationkey), 6) AS m5, 1e0 AS m8 FROM nation")
def compose_global(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    local = F.array(*(F.lit(v) for v in (1.0, 0.0, 5.0, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0)))
    m = geometry.window_to_global(local, F.lit(100), 200 + F.col("n_nationkey"), 300 + F.col("n_nationkey"), F.lit(400))
    return n.select("n_nationkey", F.get(m, 2).alias("m2"), F.get(m, 5).alias("m5"), F.get(m, 8).alias("m8")).withColumns(r6("m2", "m5", "m8"))


@query(f"{_WITH('corr')} SELECT pair_id, match_id, source_x + 100 AS source_x, source_y + 200 AS source_y, round(reference_x + 300, 6) AS reference_x, round(reference_y + 400, 6) AS reference_y FROM corr")
def offset_matches(spark, sf_dir):
    return matches.offset(view(spark, sf_dir, "corr"), 100, 200, 300, 400).select("pair_id", "match_id", "source_x", "source_y", "reference_x", "reference_y").withColumns(r6("reference_x", "reference_y"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN round(p_retailprice / (p_size % 7), 6) END AS ratio, CASE WHEN p_size % 3 = 0 THEN 2.5::DOUBLE END AS ground_scale FROM part")
def scale_ratio(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    scale = geometry.ground_scale(F.lit(2.5), F.lit(0.0), F.lit(0.0), F.lit(-2.5), F.col("p_size") % 3 == 0)
    return p.select("p_partkey", F.round(geometry.scale_ratio(F.col("p_retailprice"), F.col("p_size") % 7), 6).alias("ratio"), scale.alias("ground_scale"))


_WARP = (1.0, 0.0, 5.25, 0.0, 1.0, -3.5, 0.0, 0.0, 1.0)
_WARPED = f"""{_WITH('raster')}, g AS (SELECT y::INT AS ry, x::INT AS rx, x - 5.25::DOUBLE AS sx, y + 3.5::DOUBLE AS sy FROM range(70) a(y), range(80) b(x)),
t AS (SELECT ry, rx, floor(sy)::INT + dy AS y, floor(sx)::INT + dx AS x, (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS weight FROM g, range(2) a(dy), range(2) b(dx)),
s AS (SELECT product_id, ry, rx, sum(v * weight) AS v FROM t JOIN raster USING (y, x) GROUP BY 1, 2, 3)"""


@query(f"{_WARPED} SELECT p.product_id, g.ry AS y, g.rx AS x, round(coalesce(s.v, 0), 5) AS v FROM (SELECT DISTINCT product_id FROM raster) p CROSS JOIN g LEFT JOIN s ON s.product_id = p.product_id AND s.ry = g.ry AND s.rx = g.rx")
def warp_bilinear(spark, sf_dir):
    return raster.warp(view(spark, sf_dir, "raster"), _WARP, 70, 80).select("product_id", "y", "x", F.round("v", 5).alias("v"))


@query(f"{_WARPED} SELECT product_id, ry AS y, rx AS x, round(v, 3) AS v FROM s WHERE v > 0")
def warp_tiles(spark, sf_dir):
    px = view(spark, sf_dir, "raster")
    m = px.select("product_id").distinct().withColumn("m", F.array(*(F.lit(v) for v in _WARP)))
    warped = tiles.to_pixels(tiles.warp(tiles.from_pixels(px, 24), m, 70, 80, 24), 24)
    return warped.where("v > 0").select("product_id", "y", "x", F.round(F.col("v").cast("double"), 3).alias("v"))


def _planes(spark, sf_dir):
    """Planes, the same moved by (2, 1), and a point to refine for each supplier."""
    px = view(spark, sf_dir, "raster").select(F.col("product_id").alias("pair_id"), "y", "x", "v")
    moved = px.select("pair_id", (F.col("y") + 1).alias("y"), (F.col("x") + 2).alias("x"), "v").where("y < 64 and x < 64").unionByName(px.where("y < 1 or x < 2"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, y = ((10 + F.col("s_suppkey") * by % span).cast("double") for by, span in ((7, 43), (13, 44)))
    at = s.select(F.concat(F.lit("p"), (F.col("s_suppkey") % 25).cast("string")).alias("pair_id"), F.col("s_suppkey").alias("match_id"), x.alias("source_x"), y.alias("source_y"), (x + 1).alias("reference_x"), y.alias("reference_y"))
    return at, px, moved


_NCC = f"""{_WITH('raster')}, a AS (SELECT product_id AS pair_id, y, x, v FROM raster), b AS (SELECT pair_id, y + 1 AS y, x + 2 AS x, v FROM a WHERE y < 63 AND x < 62 UNION ALL SELECT * FROM a WHERE y < 1 OR x < 2),
p AS (SELECT concat('p', s_suppkey % 25) AS pair_id, s_suppkey AS match_id, (10 + s_suppkey * 13 % 44)::INT AS y, (10 + s_suppkey * 7 % 43)::INT AS x FROM supplier),
ps AS MATERIALIZED (SELECT pair_id, match_id, wy, wx, y + wy AS y, x + wx AS x FROM p, range(-5, 6) w1(wy), range(-5, 6) w2(wx)),
pr AS MATERIALIZED (SELECT pair_id, match_id, ty, tx, y + ty AS y, x + 1 + tx AS x FROM p, range(-8, 9) w1(ty), range(-8, 9) w2(tx)),
ss AS MATERIALIZED (SELECT pair_id, match_id, wy, wx, v AS s FROM ps JOIN a USING (pair_id, y, x)), rr AS MATERIALIZED (SELECT pair_id, match_id, ty, tx, v AS r FROM pr JOIN b USING (pair_id, y, x)),
so AS MATERIALIZED (SELECT pair_id, match_id, oy AS dy, ox AS dx, wy + oy AS ty, wx + ox AS tx, s FROM ss, range(-3, 4) o1(oy), range(-3, 4) o2(ox)),
j AS (SELECT pair_id, match_id, dy, dx, s, r FROM so JOIN rr USING (pair_id, match_id, ty, tx)),
m AS (SELECT pair_id, match_id, dy, dx, sum(s * r) - sum(s) * sum(r) / 121 AS c, (sum(s * s) - sum(s) ** 2 / 121) * (sum(r * r) - sum(r) ** 2 / 121) AS d FROM j GROUP BY 1, 2, 3, 4),
n AS (SELECT pair_id, match_id, dy, dx, CASE WHEN d > 1e-12 THEN c / sqrt(d) ELSE -1 END AS score FROM m)"""


@query(f"{_NCC} SELECT pair_id, match_id::BIGINT AS match_id, dy::INT AS dy, dx::INT AS dx, round(score, 6) AS score FROM n")
def ncc_scores(spark, sf_dir):
    return refine.scores(*_planes(spark, sf_dir)).withColumns(r6("score"))


@query(f"""{_NCC}, k AS (SELECT *, lag(score) OVER r AS l, lead(score) OVER r AS rr, lag(score) OVER c AS u, lead(score) OVER c AS dd, row_number() OVER (PARTITION BY pair_id, match_id ORDER BY round(score, 9) DESC, dy, dx) AS nth FROM n WINDOW r AS (PARTITION BY pair_id, match_id, dy ORDER BY dx), c AS (PARTITION BY pair_id, match_id, dx ORDER BY dy))
SELECT pair_id, match_id::BIGINT AS match_id, round(dx + CASE WHEN abs(l - 2 * score + rr) < 1e-8 THEN 0 ELSE least(greatest(0.5 * (l - rr) / (l - 2 * score + rr), -0.5), 0.5) END, 5) AS shift_x,
  round(dy + CASE WHEN abs(u - 2 * score + dd) < 1e-8 THEN 0 ELSE least(greatest(0.5 * (u - dd) / (u - 2 * score + dd), -0.5), 0.5) END, 5) AS shift_y FROM k WHERE nth = 1 AND score > 0 AND abs(dx) < 3 AND abs(dy) < 3""")
def subpixel_peak(spark, sf_dir):
    s = refine.scores(*_planes(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return refine.peaks(s).withColumns({c: F.round(c, 5) for c in ("shift_x", "shift_y")})


@query()
def ransac_affine(spark, sf_dir):
    return _estimated(spark, sf_dir, "affine")


@query()
def ransac_homography(spark, sf_dir):
    return _estimated(spark, sf_dir, "homography")


def _estimated(spark, sf_dir, model):
    found = ransac.estimate(view(spark, sf_dir, "corr"), model)
    return found.select("pair_id", "model", "candidates", "inliers", "problem", *(F.round(F.get("m", F.lit(i)), 2).alias(f"m{i}") for i in (2, 5)))


_XML = "concat('<a:Product xmlns:a=\"urn:x\"><a:start_date_time> ', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'Z </a:start_date_time><instrument_id>T', o_orderkey % 5, '</instrument_id></a:Product>')"


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS start_date_time, 'T' || (o_orderkey % 5) AS instrument_id FROM orders")
def xml_label_fields(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    xml = F.concat(F.lit('<a:Product xmlns:a="urn:x"><a:start_date_time> '), F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z </a:start_date_time><instrument_id>T"), (F.col("o_orderkey") % 5).cast("string"), F.lit("</instrument_id></a:Product>"))
    return o.select("o_orderkey", labels.label_fields(xml).alias("x")).select("o_orderkey", "x.start_date_time", "x.instrument_id")


_CORNERS = " UNION ALL ".join(f"SELECT product_id, y, x, valid, v::INT AS g, {'least(fy + 1, 3)' if i else 'greatest(fy, 0)'}::INT AS ty, {'least(fx + 1, 3)' if j else 'greatest(fx, 0)'}::INT AS tx, {'py - fy' if i else '1 - (py - fy)'} AS wy, {'px - fx' if j else '1 - (px - fx)'} AS wx FROM q" for i in (0, 1) for j in (0, 1))


@query(f"""{_WITH('raster')}, n AS (SELECT product_id, (y * 4 // 64)::INT AS ty, (x * 4 // 64)::INT AS tx, v::INT AS g, count(*) AS n FROM raster GROUP BY 1, 2, 3, 4),
e AS (SELECT p.product_id, a.ty::INT AS ty, b.tx::INT AS tx, c.g::INT AS g FROM (SELECT DISTINCT product_id FROM raster) p, range(4) a(ty), range(4) b(tx), range(256) c(g)),
k AS (SELECT e.*, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (product_id, ty, tx, g)),
s AS (SELECT *, sum(n) OVER t AS area, least(n, greatest(1, floor(2.0 * sum(n) OVER t / 256))) AS kept FROM k WINDOW t AS (PARTITION BY product_id, ty, tx)),
d AS (SELECT *, (area - sum(kept) OVER (PARTITION BY product_id, ty, tx))::DOUBLE / 256 AS given FROM s),
m AS (SELECT product_id, ty, tx, g, round_even(sum(kept + given) OVER (PARTITION BY product_id, ty, tx ORDER BY g ROWS UNBOUNDED PRECEDING) * 255 / area, 0) AS gray FROM d),
q AS (SELECT *, floor(py) AS fy, floor(px) AS fx FROM (SELECT *, (y + 0.5::DOUBLE) * 4 / 64 - 0.5 AS py, (x + 0.5::DOUBLE) * 4 / 64 - 0.5 AS px FROM raster)), c AS ({_CORNERS})
SELECT product_id, y, x, CASE WHEN any_value(valid) THEN round_even(least(greatest(sum(gray * wy * wx), 0), 255), 0)::INT ELSE 0 END AS v FROM c JOIN m USING (product_id, ty, tx, g) GROUP BY 1, 2, 3""")
def clahe_planes(spark, sf_dir):
    return raster.clahe(view(spark, sf_dir, "raster"), tiles=4).select("product_id", "y", "x", "v")


@query("SELECT 'r' || (o_orderkey // 1500) AS pair_id, 'completed' AS status, TRUE AS enough, TRUE AS clean, 7::DOUBLE AS dx, -4::DOUBLE AS dy FROM orders GROUP BY ALL HAVING count(*) = 1500")
def register_end_to_end(spark, sf_dir):
    """Pairs of images whose blocks of 6 x 6 pixels are 1 500 orders each, one moved by (7, -4), registered from pixels to metrics."""
    from tiepoint.plans import registration

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey DIV 1500").alias("n"), (F.col("o_orderkey") % 1500).alias("k"), F.floor(F.col("o_totalprice") * 100).alias("price"))
    full = o.groupBy("n").agg(F.count("*").alias("orders")).where("orders = 1500").select("n")
    inside = lambda c: F.explode(F.sequence(F.lit(0), F.lit(5))).alias(c)
    # few orders make many pixels, so they are dealt before, with the tasks' number, as AQE goes by their size
    px = o.join(full, "n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "n").select(F.concat(F.lit("r"), F.col("n").cast("string")).alias("pair_id"), "k", (F.col("price") % 256).cast("double").alias("v"), inside("dy")).select("*", inside("dx"))
    px = px.select("pair_id", (F.expr("k DIV 50") * 6 + F.col("dy")).cast("int").alias("py"), (F.col("k") % 50 * 6 + F.col("dx")).cast("int").alias("px"), "v")

    def side(top: int, left: int) -> DataFrame:
        placed = px.select("pair_id", F.lit(0).alias("band"), (F.col("py") - top).alias("y"), (F.col("px") - left).alias("x"), "v", F.lit(True).alias("valid"))
        return placed.where("y between 0 and 159 and x between 0 and 279")

    found = registration.register(side(10, 10), side(14, 3), registration.Config(geometry_model="affine"))
    moves = found["transforms"].select("pair_id", F.round(F.get("m", F.lit(2)), 0).alias("dx"), F.round(F.get("m", F.lit(5)), 0).alias("dy"))
    return found["metrics"].select("pair_id", "status", (F.col("inliers") > 30).alias("enough"), (F.col("inlier_ratio") > 0.7).alias("clean")).join(moves, "pair_id")


@query("""WITH RECURSIVE p AS (SELECT o_orderkey // 1024 AS product, o_orderkey AS id, o_custkey % 997 / 7e0 AS x, floor(o_totalprice) % 389 / 3e0 AS y, row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY floor(o_totalprice) % 97 DESC, o_orderkey) AS n FROM orders),
walk AS (SELECT product, 0::BIGINT AS n, []::STRUCT(x DOUBLE, y DOUBLE, id BIGINT)[] AS kept FROM p GROUP BY 1
UNION ALL SELECT w.product, p.n, CASE WHEN len(list_filter(kept, lambda k: (k.x - p.x) * (k.x - p.x) + (k.y - p.y) * (k.y - p.y) < 36)) = 0 THEN list_append(kept, {'x': p.x, 'y': p.y, 'id': p.id}) ELSE kept END FROM walk w JOIN p ON p.product = w.product AND p.n = w.n + 1),
ends AS (SELECT product, max(n) AS n FROM walk GROUP BY 1)
SELECT 's' || product AS product_id, unnest(kept).id AS kp_id FROM walk JOIN ends USING (product, n)""")
def spaced_keypoints(spark, sf_dir):
    """Points of which no two are nearer than 6, the strongest first; many are equally strong."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.floor("o_totalprice")
    k = o.select(F.concat(F.lit("s"), F.expr("o_orderkey DIV 1024").cast("string")).alias("product_id"), F.col("o_orderkey").alias("kp_id"), (F.col("o_custkey") % 997 / F.lit(7.0)).alias("x"), (price % 389 / F.lit(3.0)).alias("y"), (price % 97).cast("double").alias("response"))
    return suppression.keep_apart(k, 6.0).select("product_id", "kp_id")


@query("""WITH o AS (SELECT o_orderpriority AS product_id, o_totalprice AS v FROM orders UNION ALL SELECT 'all', o_totalprice FROM orders)
SELECT product_id, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, max(v) AS p100 FROM o GROUP BY 1""")
def exact_percentiles(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("product_id"), F.col("o_totalprice").alias("v"))
    found = quantiles.percentiles(o.unionAll(o.withColumn("product_id", F.lit("all"))), ["product_id"], "v", (0.01, 0.05, 0.5, 0.99, 1.0))
    return found.select("product_id", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p1", "p5", "p50", "p99", "p100"))))


@query("WITH c AS (SELECT o_orderpriority AS pair_id, o_custkey % 5 AS source_level, o_orderkey % 5 AS reference_level, count(*) AS inliers FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2, 3) SELECT pair_id, source_level, reference_level, inliers FROM c QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY inliers DESC, source_level, reference_level) = 1")
def best_level(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'F'")
    tried = o.groupBy(F.col("o_orderpriority").alias("pair_id"), (F.col("o_custkey") % 5).alias("source_level"), (F.col("o_orderkey") % 5).alias("reference_level")).agg(F.count("*").alias("inliers"))
    return matches.best_level(tried)


@query(f"{_WITH('corr')} SELECT pair_id, match_id FROM corr WHERE inlier QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY match_id) <= 300")
def match_lines(spark, sf_dir):
    return matches.first_inliers(view(spark, sf_dir, "corr")).select("pair_id", "match_id")


@query(f"{_WITH('corr')} SELECT pair_id, match_id FROM corr WHERE reference_x >= 600 OR reference_y >= 500")
def points_outside(spark, sf_dir):
    return points.outside(view(spark, sf_dir, "corr"), "reference", 600, 500).select("pair_id", "match_id")


@query(f"{_WITH('corr')} SELECT pair_id, match_id, source_x * 2 AS source_x, source_y * 2 AS source_y, round(reference_x * 4, 6) AS reference_x, round(reference_y * 4, 6) AS reference_y FROM corr")
def level_rescale(spark, sf_dir):
    return matches.rescale(view(spark, sf_dir, "corr"), (2.0, 2.0), (4.0, 4.0)).select("pair_id", "match_id", "source_x", "source_y", "reference_x", "reference_y").withColumns(r6("reference_x", "reference_y"))


@query(f"{_WITH('raster')} SELECT a.product_id, a.y, a.x, cast(round_even((a.v + b.v) / 2, 0) AS int) AS v FROM raster a JOIN raster b ON a.y = b.y AND a.x = b.x AND b.product_id = concat('p', cast(substr(a.product_id, 2) AS int) + 1)")
def overlay_planes(spark, sf_dir):
    """Every product with the next one."""
    px = view(spark, sf_dir, "raster")
    before = F.substring("product_id", 2, 9).cast("int") - 1
    return raster.overlay(px, px.withColumn("product_id", F.concat(F.lit("p"), before.cast("string"))), ["product_id"])


@query(f"{_WITH('raster')} SELECT product_id, g.y::INT AS y, g.x::INT AS x, r.valid FROM (SELECT * FROM range(45) a(y), range(100) b(x)) g JOIN raster r ON r.y = g.y * 64 // 45 AND r.x = g.x * 64 // 100")
def resized_mask(spark, sf_dir):
    return raster.resize_mask(view(spark, sf_dir, "raster").select("product_id", "y", "x", "valid"), 45, 100, ["product_id"])


@query("SELECT n_nationkey, least(greatest(cast(round_even((n_nationkey * 300 + 100) - 10 * 5 - 100, 0) AS int), 0), 3800) AS window_x, least(greatest(cast(round_even((n_nationkey * 350 + 100) + 10 * 3 - 100, 0) AS int), 0), 8800) AS window_y FROM nation")
def source_windows(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    m = F.array(*(F.lit(v) for v in (1.0, 0.0, 5.0, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0)))
    full, browse = (F.lit(4000), F.lit(9000)), (F.lit(400), F.lit(900))
    x, y = geometry.source_window(m, F.col("n_nationkey") * 300, F.col("n_nationkey") * 350, F.lit(200), F.lit(200), full, full, browse, browse)
    return n.select("n_nationkey", x.alias("window_x"), y.alias("window_y"))


@query(f"""{_WITH('browse')} SELECT a.member AS source_member, b.member AS reference_member, round(abs(epoch_us(a.start) - epoch_us(b.start)) / 1e6, 6) AS delta FROM browse a JOIN browse b ON a.sensor_view = 'f' AND b.sensor_view = 'n' AND cast(a.start AS date) = cast(b.start AS date) AND abs(epoch_us(a.start) - epoch_us(b.start)) <= 600000000""")
def time_band_join(spark, sf_dir):
    b = view(spark, sf_dir, "browse").withColumn("date", F.to_date("start"))
    side = lambda v, n: b.where(F.col("sensor_view") == v).select("date", F.col("member").alias(n), "start")
    return pairing.time_band(side("f", "source_member"), side("n", "reference_member"), ["date"], 600.0).select("source_member", "reference_member", "delta").withColumns(r6("delta"))


@query(f"{_WITH('metric')} SELECT DISTINCT data_level, inliers FROM metric WHERE status = 'failed' EXCEPT SELECT data_level, inliers FROM metric WHERE status = 'completed'")
def failed_only_keys(spark, sf_dir):
    m = view(spark, sf_dir, "metric")
    return m.where("status = 'failed'").select("data_level", "inliers").distinct().exceptAll(m.where("status = 'completed'").select("data_level", "inliers").distinct())


@query("SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda v: cast(cast(floor(v::DOUBLE * 1000) AS bigint) AS varchar)), ',')) AS pixel_sha256 FROM embeddings")
def pixel_digest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.sha2(F.array_join(F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("string")), ","), 256).alias("pixel_sha256"))


@query(f"""{_WITH('raster')}, p AS (SELECT product_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM raster WHERE valid GROUP BY 1),
g AS (SELECT product_id, CASE WHEN valid THEN cast(trunc(least(greatest((v - lo) * 255 / (hi - lo), 0), 255)) AS int) ELSE 0 END AS g, (y + 0.5) * 40 / 64 - 0.5 AS py, (x + 0.5) * 40 / 64 - 0.5 AS px FROM raster JOIN p USING (product_id)),
e AS (SELECT product_id, g, floor(py) + dy AS y, floor(px) + dx AS x, (1 - abs(py - floor(py) - dy)) * (1 - abs(px - floor(px) - dx)) AS w FROM g, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
SELECT product_id, y::INT AS y, x::INT AS x, floor(round(sum(g * w) / sum(w), 9) + 0.5)::INT AS v FROM e WHERE w > 0 AND y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 39 GROUP BY ALL""")
def preview_planes(spark, sf_dir):
    """Previews of 40 pixels a side."""
    return drawing.preview(view(spark, sf_dir, "raster"), 40).select("product_id", "y", "x", "v")


@query(f"""{_WITH('corr')}, f AS (SELECT pair_id, round_even(source_x, 0)::INT AS x0, round_even(source_y, 0)::INT AS y0, round_even(reference_x, 0)::INT + 640 AS x1, round_even(reference_y, 0)::INT AS y1 FROM corr WHERE inlier QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY match_id) <= 300),
s AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM f), t AS (SELECT *, unnest(range(0, n + 1)) AS t FROM s),
d AS (SELECT pair_id, CASE WHEN n = 0 THEN y0 ELSE floor(y0 + (y1 - y0) * t / n + 0.5) END::INT AS y, CASE WHEN n = 0 THEN x0 ELSE floor(x0 + (x1 - x0) * t / n + 0.5) END::INT AS x FROM t
UNION SELECT pair_id, (y + dy)::INT, (x + dx)::INT FROM (SELECT pair_id, x0 AS x, y0 AS y FROM f UNION ALL SELECT pair_id, x1, y1 FROM f), range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx > 6.25 AND dy * dy + dx * dx < 12.25)
SELECT pair_id, floor(y / 64)::INT AS ty, floor(x / 64)::INT AS tx, count(*) AS pixels, sum(y)::BIGINT AS sum_y, sum(x)::BIGINT AS sum_x FROM d GROUP BY ALL""")
def match_line_tiles(spark, sf_dir):
    """What the lines of the first 300 inliers cover, by tile."""
    c = view(spark, sf_dir, "corr")
    drawn = drawing.match_marks(c, c.select("pair_id").distinct().withColumn("width", F.lit(640))).select("pair_id", "y", "x").distinct()
    tile = lambda a: F.floor(F.col(a) / 64).cast("int").alias(f"t{a}")
    return drawn.groupBy("pair_id", tile("y"), tile("x")).agg(F.count("*").alias("pixels"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))
