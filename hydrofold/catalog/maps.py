"""Queries over the self-organizing map and its cluster reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import BASE, samples
from ..operators import clusters, features, forests, som
from ..operators.joins import grid_left_join
from ..plans.maps import som_analysis, som_sweep
from .registry import register, rounded, r

COLUMNS = ["na", "ca", "ph", "temperature"]
SCALED = [f"{c}_s" for c in COLUMNS]
KEY = "sample_id"


def _book(size: int) -> som.Codebook:
    return som.grid_codebook(SCALED, size, size)


def _scaled(spark, d):
    df = samples(spark, d).dropna("any", subset=COLUMNS)
    return features.min_max_scale(df, features.min_max(df, COLUMNS), "_s")


def assigned(spark, d, size: int = 4):
    """Samples on a fixed map, so that any engine gives the same clusters."""
    return som.som_assign(_scaled(spark, d), _book(size))


def map_sql(size: int = 4, tag: str = "") -> str:
    book = _book(size)
    cells = ", ".join(f"({i}, {', '.join(repr(float(w)) + 'e0' for w in row)})" for i, row in enumerate(book.weights))
    places = ", ".join(f"({i}, {float(x)!r}e0, {float(y)!r}e0)" for i, (x, y) in enumerate(book.positions()))
    square = " + ".join(f"({c}_s - w{i}) * ({c}_s - w{i})" for i, c in enumerate(COLUMNS))
    return f"""limits{tag} AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) - min({c}) AS {c}_w' for c in COLUMNS)} FROM samples
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COLUMNS)}),
scaled{tag} AS (SELECT samples.*, {', '.join(f'({c} - {c}_lo) / {c}_w AS {c}_s' for c in COLUMNS)} FROM samples, limits{tag}
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COLUMNS)}),
book{tag}(cell, {', '.join(f'w{i}' for i in range(len(COLUMNS)))}) AS (VALUES {cells}),
places{tag}(cell, px, py) AS (VALUES {places}),
ranked{tag} AS (SELECT sample_id, cell, {square} AS d2, row_number() OVER (PARTITION BY sample_id ORDER BY {square}, cell) AS rk FROM scaled{tag}, book{tag}),
assigned{tag} AS (SELECT s.*, (a.cell // {size})::INT AS som_x, (a.cell % {size})::INT AS som_y, sqrt(a.d2) AS distance,
  abs(sqrt((p.px - u.px) * (p.px - u.px) + (p.py - u.py) * (p.py - u.py)) - 1) < 1e-6 AS second_touches
  FROM scaled{tag} s JOIN ranked{tag} a ON s.sample_id = a.sample_id AND a.rk = 1 JOIN ranked{tag} b ON s.sample_id = b.sample_id AND b.rk = 2
  JOIN places{tag} p ON p.cell = a.cell JOIN places{tag} u ON u.cell = b.cell)"""


MAP = map_sql()


def _assign_sql() -> tuple[str, str]:
    """Best and second cell of each sample out of one list of distances a row."""
    book = _book(4)
    cells = "[" + ", ".join("[" + ", ".join(f"{float(w)!r}::DOUBLE" for w in row) + "]" for row in book.weights) + "]"
    touching = "[" + ", ".join("[" + ", ".join(str(bool(t)).lower() for t in row) + "]" for row in book.neighbours()) + "]"
    square = " + ".join(f"({c} - w[{i + 1}]) * ({c} - w[{i + 1}])" for i, c in enumerate(SCALED))
    ctes = MAP.split(",\nbook(")[0] + f""",
measured AS (SELECT sample_id, list_transform({cells}, lambda w: {square}) AS d2 FROM scaled),
firsts AS (SELECT *, list_position(d2, list_min(d2)) AS a FROM measured),
seconds AS (SELECT *, list_transform(d2, lambda x, i: CASE WHEN i = a THEN 'infinity'::DOUBLE ELSE x END) AS others FROM firsts)"""
    return ("SELECT sample_id, ((a - 1) // 4)::INT AS som_x, ((a - 1) % 4)::INT AS som_y, sqrt(d2[a]) AS distance, "
            f"({touching})[a][list_position(others, list_min(others))] AS second_touches FROM seconds"), ctes


@register(*_assign_sql())
def som_assign(spark, d):
    return assigned(spark, d).select("sample_id", "som_x", "som_y", "distance", "second_touches")


@register("SELECT sample_id, (cell // 4)::INT AS som_x, (cell % 4)::INT AS som_y FROM ranked WHERE rk = 1", MAP)
def best_matching_unit(spark, d):
    return assigned(spark, d).select("sample_id", "som_x", "som_y")


@register(f"SELECT count(*) AS n, {r('avg(distance)')} AS quantization_error, {r('avg(CASE WHEN second_touches THEN 0e0 ELSE 1e0 END)')} AS topographic_error FROM assigned", MAP)
def som_quality(spark, d):
    return rounded(som.som_quality(assigned(spark, d)), "quantization_error", "topographic_error")


@register(" UNION ALL ".join(f"""SELECT {s} AS size, {r('avg(distance)')} AS q_mean, {r('avg(CASE WHEN second_touches THEN 0e0 ELSE 1e0 END)')} AS t_mean,
  1::BIGINT AS runs FROM assigned{s}""" for s in (2, 3, 4)), ", ".join(map_sql(s, str(s)) for s in (2, 3, 4)))
def errors_by_size(spark, d):
    errors = None
    for size in (2, 3, 4):
        one = som.som_quality(assigned(spark, d, size)).withColumn("size", F.lit(size))
        errors = one if errors is None else errors.unionByName(one)
    return rounded(som.errors_by_size(errors), "q_mean", "t_mean")


@register(f"""SELECT (p.cell // 4)::INT AS som_x, (p.cell % 4)::INT AS som_y, {', '.join(f'{r(f"sum(f * s{i}) / sum(f * n)")} AS {c}' for i, c in enumerate(SCALED))}
  FROM influence p JOIN sums ON p.other = sums.cell GROUP BY p.cell""", MAP + f""",
sums AS (SELECT cell, count(*) AS n, {', '.join(f'sum({c}) AS s{i}' for i, c in enumerate(SCALED))} FROM ranked JOIN scaled USING (sample_id) WHERE rk = 1 GROUP BY 1),
influence AS (SELECT p.cell, o.cell AS other, exp(-((p.px - o.px) * (p.px - o.px) + (p.py - o.py) * (p.py - o.py)) / {2 * som.SIGMA ** 2}e0) AS f
  FROM places p, places o)""")
def som_pass(spark, d):
    """One training pass from a fixed codebook."""
    book = som.som_fit(_scaled(spark, d).select("sample_id", *SCALED), SCALED, epochs=1, start=_book(4))
    return _book_rows(spark, book)


@register()
def som_fit(spark, d):
    df = _scaled(spark, d).select("sample_id", *SCALED).persist()
    book = som.som_fit(df, SCALED)
    df.unpersist()
    return som.som_assign(df, book).select("sample_id", "som_x", "som_y", "distance")


_ONLINE = {"passes": 1, "rounds": 40, "shards": 3, "seed": 42}


def _online_sql() -> tuple[str, str]:
    """The first round of online training, as a walk through each shard's visits; cells are lists in one row a shard."""
    d, book, decay, cells = len(SCALED), _book(4), som.Decay(), 16
    digest = lambda text: f"CAST(concat('0x', substr(md5({text}), 1, 13)) AS BIGINT)"
    start = "[" + ", ".join("[" + ", ".join(f"{float(w)!r}::DOUBLE" for w in row) + "]" for row in book.weights) + "]"
    p = book.positions()
    grid = "[" + ", ".join("[" + ", ".join(f"{float(((a - b) ** 2).sum())!r}::DOUBLE" for b in p) + "]" for a in p) + "]"
    gaps = " + ".join(f"(v.x[{j}] - c[{j}]) * (v.x[{j}] - c[{j}])" for j in range(1, d + 1))
    moved = ", ".join(f"c[{j}] + h[i] * (n.x[{j}] - c[{j}])" for j in range(1, d + 1))
    ctes = MAP + f""",
visits AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY t, {', '.join(f'x[{j}]' for j in range(1, d + 1))}) AS k, x,
    {decay.rate}e0 * pow({decay.last_rate}e0 / {decay.rate}e0, t) AS a, {decay.sigma}e0 * pow({decay.last_sigma!r}e0 / {decay.sigma}e0, t) AS width
  FROM (SELECT {digest("concat('42:', sample_id)")} % {_ONLINE['shards']} AS shard, {digest("concat('42:0:', sample_id)")} / 4503599627370496e0 AS t,
        [{', '.join(SCALED)}] AS x FROM scaled)
  WHERE t < 1e0 / {_ONLINE['rounds']}),
walk AS (
  WITH RECURSIVE steps AS (
    SELECT shard, 0::BIGINT AS k, {start} AS w, list_transform(range({cells}), lambda i: 0e0) AS mass FROM (SELECT DISTINCT shard FROM visits)
    UNION ALL
    SELECT n.shard, n.k, list_transform(n.w, lambda c, i: [{moved}]), list_transform(n.mass, lambda m, i: m + h[i])
    FROM (SELECT v.shard, v.k, v.x, s.w, s.mass, list_transform({grid}[list_position(g.gaps, list_min(g.gaps))], lambda e: v.a * exp(-e / (2 * v.width * v.width))) AS h
          FROM steps s JOIN visits v ON v.shard = s.shard AND v.k = s.k + 1,
          LATERAL (SELECT list_transform(s.w, lambda c: {gaps}) AS gaps) g) n)
  SELECT * FROM steps),
ends AS (SELECT w, mass FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY k DESC) AS last FROM walk) WHERE last = 1)"""
    means = ", ".join(f"{r(f'sum(mass[cell] * w[cell][{j + 1}]) / sum(mass[cell])')} AS {c}" for j, c in enumerate(SCALED))
    return f"SELECT ((cell - 1) // 4)::INT AS som_x, ((cell - 1) % 4)::INT AS som_y, {means} FROM ends, range(1, {cells + 1}) g(cell) GROUP BY cell", ctes


def _book_rows(spark, book):
    rows = [(i // book.y, i % book.y, *map(float, w)) for i, w in enumerate(book.weights)]
    return rounded(spark.createDataFrame(rows, "som_x int, som_y int, " + ", ".join(f"{c} double" for c in SCALED)), *SCALED)


@register(*_online_sql())
def som_online_round(spark, d):
    """The first of forty rounds of online training from a fixed codebook, in three shards."""
    visits = som.online_visits(_scaled(spark, d), KEY, SCALED, _ONLINE["passes"], _ONLINE["shards"], _ONLINE["seed"])
    return _book_rows(spark, som.online_round(visits, _book(4), 0.0, 1 / _ONLINE["rounds"], _ONLINE["passes"]))


@register()
def som_fit_online(spark, d):
    df = _scaled(spark, d).select(KEY, *SCALED)
    return som.som_assign(df, som.som_fit_online(df, KEY, SCALED)).select(KEY, "som_x", "som_y", "distance")


@register()
def som_sweep_(spark, d):
    return som_sweep(samples(spark, d), {"base": BASE, "base_ph": [*BASE, "ph"]})


@register()
def som_analysis_(spark, d):
    return som_analysis(samples(spark, d), [*BASE, "ph"], ["temperature", "ph", "na"]).profile


@register(f"""SELECT g.som_x, g.som_y, n, temperature FROM (SELECT (i % 4)::INT AS som_x, (i // 4)::INT AS som_y FROM range(16) g(i)) g
  LEFT JOIN (SELECT som_x, som_y, count(*) AS n, {r('avg(temperature)')} AS temperature FROM assigned GROUP BY 1, 2) USING (som_x, som_y)""", MAP)
def grid_left_join_(spark, d):
    means = clusters.cluster_means(assigned(spark, d), ["temperature"])
    return rounded(grid_left_join(spark, 4, 4, means), "temperature")


_MEANS = ["na", "ca", "mg", "ph", "temperature"]


@register("SELECT som_x, som_y, count(*) AS n, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in _MEANS) + " FROM assigned GROUP BY 1, 2", MAP)
def cluster_means(spark, d):
    return rounded(clusters.cluster_means(assigned(spark, d), _MEANS), *_MEANS)


@register("""SELECT som_x, som_y, first(rock_type ORDER BY n DESC, rock_type) FILTER (rock_type IS NOT NULL) AS rock_type FROM (
  SELECT som_x, som_y, rock_type, count(*) AS n FROM assigned GROUP BY 1, 2, 3) GROUP BY 1, 2""", MAP)
def cluster_mode(spark, d):
    return clusters.cluster_mode(assigned(spark, d), "rock_type")


@register("SELECT som_x, som_y, rock_type, count(*) AS n FROM assigned WHERE rock_type IS NOT NULL GROUP BY 1, 2, 3", MAP)
def cluster_category_counts(spark, d):
    return clusters.cluster_category_counts(assigned(spark, d), "rock_type")


@register("SELECT som_x, som_y, string_agg(DISTINCT period, ', ' ORDER BY period) AS period FROM assigned WHERE period IS NOT NULL GROUP BY 1, 2", MAP)
def cluster_distinct(spark, d):
    return clusters.cluster_distinct(assigned(spark, d), "period")


_PROFILE = MAP + """,
vals AS (SELECT som_x, som_y, feature, value FROM assigned UNPIVOT (value FOR feature IN (na, ca, ph, temperature, mg))),
whole AS (SELECT feature, count(*) AS n_all, sum(value) AS s_all, stddev_samp(value) AS sd FROM vals GROUP BY 1),
profile AS (SELECT som_x, som_y, feature, n, n_all - n AS n_rest, s / n AS mean_cluster, (s_all - s) / (n_all - n) AS mean_rest,
  (s / n - s_all / n_all) / sd AS z_score, (s / n) / ((s_all - s) / (n_all - n)) AS factor
  FROM (SELECT som_x, som_y, feature, count(*) AS n, sum(value) AS s FROM vals GROUP BY 1, 2, 3) JOIN whole USING (feature)
  WHERE n >= 3 AND n_all - n >= 3 AND sd > 0)"""
_FEATURES = [*COLUMNS, "mg"]


@register(f"""SELECT som_x, som_y, feature, n, n_rest, {r('mean_cluster')} AS mean_cluster, {r('mean_rest')} AS mean_rest, {r('z_score')} AS z_score,
  {r('factor')} AS factor FROM profile""", _PROFILE)
def cluster_profile(spark, d):
    return rounded(clusters.cluster_profile(assigned(spark, d), _FEATURES), "mean_cluster", "mean_rest", "z_score", "factor")


@register(f"""SELECT som_x, som_y, feature, {r('z_score')} AS z_score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY som_x, som_y ORDER BY abs(z_score) DESC, feature) AS rank FROM profile) WHERE rank <= 3""", _PROFILE)
def top_discriminators(spark, d):
    top = clusters.top_discriminators(clusters.cluster_profile(assigned(spark, d), _FEATURES), 3)
    return rounded(top.select("som_x", "som_y", "feature", "z_score", "rank"), "z_score")


@register(f"""SELECT som_x, som_y, feature, {r('abs(z_score)')} AS importance, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY som_x, som_y ORDER BY abs(z_score) DESC, feature) AS rank FROM profile) WHERE rank <= 2""", _PROFILE)
def top_importances(spark, d):
    scores = clusters.cluster_profile(assigned(spark, d), _FEATURES).select("som_x", "som_y", "feature", F.abs("z_score").alias("importance"))
    return rounded(clusters.top_importances(scores, 2), "importance")


@register(f"""SELECT som_x, som_y, feature, n1, n2, {r('u')} AS u, {r('(greatest(u, n1 * n2 - u) - n1 * n2 / 2e0 - 0.5e0) / sqrt(n1 * n2 / 12e0 * ((n + 1) - tie / (n * (n - 1e0))))')} AS score
  FROM (SELECT som_x, som_y, feature, n1, n - n1 AS n2, n, rs - n1 * (n1 + 1) / 2e0 AS u, tie FROM (
    SELECT som_x, som_y, feature, count(*) AS n1, sum(rk + (c - 1) / 2e0) AS rs FROM (
      SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) AS rk, count(*) OVER (PARTITION BY feature, value) AS c FROM vals) GROUP BY 1, 2, 3)
    JOIN (SELECT feature, sum(c)::BIGINT AS n, sum(pow(c::DOUBLE, 3) - c) AS tie FROM (SELECT feature, value, count(*) AS c FROM vals GROUP BY 1, 2) GROUP BY 1) USING (feature))
  WHERE n1 >= 3 AND n2 >= 3""", _PROFILE)
def mann_whitney(spark, d):
    return rounded(clusters.mann_whitney(assigned(spark, d), _FEATURES), "u", "score").drop("tied")


@register()
def cluster_profile_tested(spark, d):
    return clusters.top_discriminators(clusters.tested_profile(assigned(spark, d), _FEATURES), 10)


@register(f"""SELECT som_x, som_y, feature, n, {r('sigma')} AS sigma, {r("CASE WHEN feature = 'ph' THEN mu ELSE exp(mu) - 1 END")} AS centre,
  {r("CASE WHEN sigma IS NOT NULL THEN greatest(0e0, CASE WHEN feature = 'ph' THEN mu - sigma ELSE exp(mu - sigma) - 1 END) END")} AS low,
  {r("CASE WHEN feature = 'ph' THEN mu + sigma ELSE exp(mu + sigma) - 1 END")} AS high FROM (
  SELECT som_x, som_y, feature, count(*) AS n, avg(v) AS mu, stddev_samp(v) AS sigma FROM (
    SELECT *, CASE WHEN feature = 'ph' THEN value ELSE ln(1 + value) END AS v FROM vals) GROUP BY 1, 2, 3)""", _PROFILE)
def log_range(spark, d):
    return rounded(clusters.log_range(assigned(spark, d), _FEATURES), "sigma", "centre", "low", "high")


@register(f"""SELECT som_x, som_y, feature, point::INT AS point, {r('x')} AS x, n, {r('sum(exp(-0.5e0 * pow((x - v) / h, 2))) / (n * h * sqrt(2 * pi()))')} AS density FROM (
    SELECT som_x, som_y, feature, n, h, point, lo + (hi - lo) / 99 * point AS x FROM (
      SELECT som_x, som_y, feature, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2e0) AS h FROM logged GROUP BY 1, 2, 3
      HAVING count(*) >= 3 AND stddev_samp(v) > 0), range(100) g(point))
  JOIN logged USING (som_x, som_y, feature) GROUP BY som_x, som_y, feature, point, x, n, h""",
          _PROFILE + """, logged AS (SELECT som_x, som_y, feature, CASE WHEN feature IN ('ph', 'temperature') THEN value ELSE log10(value) END AS v
  FROM vals WHERE feature IN ('ph', 'temperature') OR value > 0)""")
def kde(spark, d):
    return rounded(clusters.kde(assigned(spark, d), _FEATURES), "x", "density")


@register()
def rf_importance_global(spark, d):
    return clusters.rf_importance_global(assigned(spark, d), _FEATURES)


@register()
def rf_importance_local(spark, d):
    return clusters.rf_importance_local(assigned(spark, d), _FEATURES)


_GAINS = MAP + f""",
vals AS (SELECT som_x, som_y, feature, value FROM (SELECT * FROM assigned WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _FEATURES)})
  UNPIVOT (value FOR feature IN ({', '.join(_FEATURES)}))),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{', '.join(f'{i}e0 / {forests.BINS}' for i in range(1, forests.BINS))}]))) AS e FROM vals GROUP BY 1),
bins AS (SELECT som_x, som_y, feature, len(list_filter(e, lambda x: x < value)) AS bin, count(*) AS n FROM vals JOIN edges USING (feature) GROUP BY 1, 2, 3, 4),
cuts AS (SELECT feature, unnest(range(0, len(e))) AS cut FROM edges),
cells AS (SELECT DISTINCT som_x, som_y FROM bins),
sides AS (SELECT c.som_x, c.som_y, k.feature, k.cut, sum(b.n) AS w, sum(CASE WHEN bin <= cut THEN b.n ELSE 0 END) AS wl,
    sum(CASE WHEN b.som_x = c.som_x AND b.som_y = c.som_y THEN b.n ELSE 0 END) AS i,
    sum(CASE WHEN bin <= cut AND b.som_x = c.som_x AND b.som_y = c.som_y THEN b.n ELSE 0 END) AS il
  FROM cells c, cuts k JOIN bins b USING (feature) GROUP BY 1, 2, 3, 4),
gains AS (SELECT *, 2e0 * i * (w - i) / (w * w) - wl / w * (2e0 * il * (wl - il) / (wl * wl)) - (w - wl) / w * (2e0 * (i - il) * (w - wl - i + il) / ((w - wl) * (w - wl))) AS gain
  FROM (SELECT som_x, som_y, feature, cut, w::DOUBLE AS w, wl::DOUBLE AS wl, i::DOUBLE AS i, il::DOUBLE AS il FROM sides) WHERE wl > 0 AND wl < w)"""


@register(f"SELECT som_x, som_y, feature, cut::INT AS bin, {r('gain')} AS gain FROM gains WHERE {r('gain')} > 0", _GAINS)
def forest_root_gains(spark, d):
    """What the first level of every forest can gain, by splits between all bins."""
    return rounded(forests.root_gains(assigned(spark, d), _FEATURES, ["som_x", "som_y"]), "gain").where("gain > 0")
