"""Registry of the engine's queries over the driver tables, each with the same result said in SQL where SQL can say it.

Numbers are published with six decimals, rounded by the same arithmetic on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import calibrate as cal
from ..operators import coreset as core
from ..operators import detections as det
from ..operators import features, knn, maps, stats
from ..operators import postprocess as post
from . import tables as t
from .algorithms import Dfkde, Direct, EfficientAd, Grid, PaDiM, PatchCore, Spade, Yolo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def r6(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v * 1e6 + 0.5) / 1e6


def _pixels(m: DataFrame) -> DataFrame:
    return maps.pixels_of(m).select("image_id", "y", "x", r6("v").alias("v"))


# ---- SQL fragments -------------------------------------------------------------------------------------------------

P = """p AS (SELECT vec_id // 16 AS image_id, (vec_id % 16)::INT AS loc, ((vec_id % 16) // 4)::INT AS y, (vec_id % 4)::INT AS x,
    embedding::DOUBLE[] AS feat FROM embeddings WHERE vec_id < (SELECT count(*) // 16 * 16 FROM embeddings))"""


def R6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _sum(term: str, n: int) -> str:
    """term with {i} summed over 1..n, from left to right."""
    return "0.0 + " + " + ".join(term.format(i=i) for i in range(1, n + 1))


def _resize_w(out: int, size: int) -> str:
    """(o, i, w) rows of bilinear weights."""
    at = f"((o + 0.5) * {size} / {out} - 0.5)"
    return f"""(SELECT o, least(greatest(floor({at}) + k, 0), {size} - 1)::INT AS i,
        sum(CASE WHEN k = 0 THEN 1 - ({at} - floor({at})) ELSE {at} - floor({at}) END) AS w
        FROM range({out}) AS r(o), range(2) AS s(k) GROUP BY 1, 2)"""


def _gauss_w(size: int, taps: int, sigma: float, mirror: bool) -> str:
    """(o, i, w) rows of Gaussian weights with the border rule."""
    half, last = taps // 2, size - 1
    i = f"(CASE WHEN o + d < 0 THEN -(o + d) WHEN o + d > {last} THEN 2 * {last} - (o + d) ELSE o + d END)" if mirror else f"least(greatest(o + d, 0), {last})"
    return f"""(SELECT o, {i}::INT AS i, sum(exp(-(d * d) / (2.0 * {sigma} * {sigma})) / z) AS w FROM range({size}) AS r(o), range(-{half}, {half + 1}) AS s(d),
        (SELECT sum(exp(-(e * e) / (2.0 * {sigma} * {sigma}))) AS z FROM range(-{half}, {half + 1}) AS u(e)) GROUP BY 1, 2)"""


def _separable(src: str, wy: str, wx: str) -> str:
    """Pixels (image_id, y, x, v) of src under row and column weights."""
    return f"(SELECT s.image_id, wy.o AS y, wx.o AS x, sum(wy.w * wx.w * s.v) AS v FROM {src} s JOIN {wy} wy ON wy.i = s.y JOIN {wx} wx ON wx.i = s.x GROUP BY 1, 2, 3)"


GRID = "g AS (SELECT s_suppkey AS image_id, y::INT AS y, x::INT AS x, ((s_suppkey * 7 + y * y * 3 + x * x * 5 + x * y * 2) % 101) / 100.0::DOUBLE AS v FROM supplier, range(12) AS a(y), range(12) AS b(x))"


# ---- features ------------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT image_id, loc, y, x, c::INT AS channel, feat[c + 1] AS v FROM p, range(32) AS r(c)")
def flatten_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = features.tensors_from_patches(t.patches(spark, sf_dir), 4, 4, "a", 0, 32)
    return features.to_patches(planes).select("image_id", "loc", "y", "x", F.posexplode("feat").alias("channel", "v"))


@query(f"WITH {P} SELECT image_id, loc, feat[6] AS c0, feat[1] AS c1, feat[64] AS c2 FROM p")
def select_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.select_channels(t.patches(spark, sf_dir), [5, 0, 63])
    return out.select("image_id", "loc", *[F.col("feat")[i].alias(f"c{i}") for i in range(3)])


@query(f"WITH {P} SELECT image_id, loc, feat[1] AS c0, feat[2] AS c1, feat[33] AS c2, feat[34] AS c3 FROM p")
def concat_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    both = features.concat_layers([features.tensors_from_patches(p, 4, 4, "a", 0, 2), features.tensors_from_patches(p, 4, 4, "b", 32, 2)])
    return features.to_patches(both).select("image_id", "loc", *[F.col("feat")[i].alias(f"c{i}") for i in range(4)])


@query(f"WITH {P} SELECT image_id, loc, {R6('(feat[1] + feat[33]) / 2')} AS c0, {R6('(feat[2] + feat[34]) / 2')} AS c1 FROM p")
def mean_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    both = features.mean_layers([features.tensors_from_patches(p, 4, 4, "a", 0, 2), features.tensors_from_patches(p, 4, 4, "b", 32, 2)])
    return features.to_patches(both).select("image_id", "loc", *[r6(F.col("feat")[i]).alias(f"c{i}") for i in range(2)])


def _pooled(spark: SparkSession, sf_dir: str, kernel: int, stride: int, padding: int) -> DataFrame:
    out = features.avg_pool(features.tensors_from_patches(t.patches(spark, sf_dir), 4, 4, "a", 0, 2), kernel, stride, padding)
    return features.to_patches(out).select("image_id", "y", "x", *[r6(F.col("feat")[i]).alias(f"c{i}") for i in range(2)])


@query(f"""WITH {P} SELECT p.image_id, o.y::INT AS y, o.x::INT AS x, {R6('sum(feat[1]) / 9')} AS c0, {R6('sum(feat[2]) / 9')} AS c1
    FROM p JOIN (SELECT y, x FROM range(4) AS a(y), range(4) AS b(x)) o ON abs(p.y - o.y) <= 1 AND abs(p.x - o.x) <= 1 GROUP BY 1, 2, 3""")
def avg_pool_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, 3, 1, 1)


@query(f"WITH {P} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, {R6('avg(feat[1])')} AS c0, {R6('avg(feat[2])')} AS c1 FROM p GROUP BY 1, 2, 3")
def avg_pool_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, 2, 2, 0)


def _resized(spark: SparkSession, sf_dir: str, step: int, side: int, out: int) -> DataFrame:
    planes = features.resize(features.tensors_from_patches(t.patches(spark, sf_dir), side, side, "a", 0, 1, step), out, out)
    return features.to_patches(planes).select("image_id", "y", "x", r6(F.col("feat")[0]).alias("v"))


@query(f"""WITH {P}, s AS (SELECT image_id, y // 2 AS y, x // 2 AS x, feat[1] AS v FROM p WHERE y % 2 = 0 AND x % 2 = 0)
    SELECT image_id, y::INT AS y, x::INT AS x, {R6('v')} AS v FROM {_separable('s', _resize_w(4, 2), _resize_w(4, 2))}""")
def resize_2_to_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, 2, 2, 4)


@query(f"""WITH {P}, s AS (SELECT image_id, y, x, feat[1] AS v FROM p)
    SELECT image_id, y::INT AS y, x::INT AS x, {R6('v')} AS v FROM {_separable('s', _resize_w(16, 4), _resize_w(16, 4))}""")
def resize_4_to_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, 1, 4, 16)


@query(f"WITH {P} SELECT image_id, loc, y, x, {R6('sqrt(' + _sum('feat[{i}] * feat[{i}]', 64) + ')')} AS v FROM p")
def channel_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.channel_l2(t.patches(spark, sf_dir)).withColumn("v", r6("v"))


_DIFF = "sqrt(" + " + ".join(f"(feat[{i}] - feat[{i + 16}]) * (feat[{i}] - feat[{i + 16}])" for i in range(1, 17)) + ")"


@query(f"WITH {P} SELECT image_id, loc, y, x, {R6(_DIFF)} AS v FROM p")
def channel_l2_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return features.channel_l2_diff(t.part(p, 0, 16), t.part(p, 16, 16)).withColumn("v", r6("v"))


@query(f"""WITH {P}, s AS (SELECT image_id, y, x, feat[1] AS v FROM p), m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM s WINDOW w AS (PARTITION BY image_id))
    SELECT image_id, y, x, {R6('CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0 END')} AS v FROM m""")
def minmax_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir).withColumn("v", F.col("feat")[0])
    return _pixels(maps.minmax_map(maps.maps_from_pixels(p, 4, 4)))


@query(f"WITH {P} SELECT image_id, y, x, {R6('(feat[1] * 3.0 + feat[2] * 1.0) / 4.0')} AS v FROM p")
def blend_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    one, two = (maps.maps_from_pixels(p.withColumn("v", F.col("feat")[i]), 4, 4) for i in (0, 1))
    return _pixels(maps.blend_maps(one, two, 3.0, 1.0))


# ---- nearest neighbours, banks, PatchCore ---------------------------------------------------------------------------

_D2 = _sum("(q.feat[{i}] - b.feat[{i}]) * (q.feat[{i}] - b.feat[{i}])", 64)
_NEAR = f"""near AS (SELECT q.image_id, q.loc, b.image_id * 16 + b.loc AS bank_id, {_D2} AS d2 FROM p q, p b WHERE q.image_id % 4 = 3 AND b.image_id % 4 <> 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, loc ORDER BY d2, bank_id) AS rank FROM near)"""


@query(f"WITH {P}, {_NEAR} SELECT image_id, loc, rank::INT AS rank, bank_id, {R6('d2')} AS d2 FROM ranked WHERE rank <= 9")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return knn.knn(t.test(p), t.bank_rows(t.normal(p)), 9, ["image_id", "loc"]).withColumn("d2", r6("d2"))


@query(f"WITH {P}, {_NEAR} SELECT image_id, loc, rank::INT AS rank, bank_id, {R6('d2')} AS d2 FROM ranked WHERE rank <= 3")
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return knn.knn(t.test(p), t.bank_rows(t.normal(p)), 3, ["image_id", "loc"], strategy="blocks").withColumn("d2", r6("d2"))


_FULL = {"ratio": 1.0}
_OUT = Grid(4, 4, 16, 16, 1.0)


def _patchcore(spark: SparkSession, sf_dir: str, k: int, grid: Grid = _OUT) -> tuple[PatchCore, DataFrame]:
    p = t.patches(spark, sf_dir)
    return PatchCore.fit(t.normal(p), grid, num_neighbors=k, **_FULL), t.test(p)


@query(f"WITH {P}, {_NEAR} SELECT image_id, loc, {R6('sqrt(d2)')} AS v, bank_id FROM ranked WHERE rank = 1")
def patchcore_patch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _patchcore(spark, sf_dir, 1)
    return model.patch_scores(test).select("image_id", "loc", r6("v").alias("v"), "bank_id")


@query(f"WITH {P}, {_NEAR} SELECT image_id, {R6('max(sqrt(d2))')} AS score FROM ranked WHERE rank = 1 GROUP BY image_id")
def patchcore_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _patchcore(spark, sf_dir, 1)
    return model.image_scores(model.patch_scores(test)).select("image_id", r6("score").alias("score"))


@query(f"""WITH {P}, {_NEAR}, top AS (SELECT image_id, arg_max(bank_id, (sqrt(d2), -loc)) AS support, max(sqrt(d2)) AS v FROM ranked WHERE rank = 1 GROUP BY image_id),
    self AS (SELECT s.support, {_D2.replace('q.', 's.')} AS d2, b.image_id * 16 + b.loc AS bank_id FROM (SELECT DISTINCT support, p.feat FROM top JOIN p ON p.image_id * 16 + p.loc = support) s, p b WHERE b.image_id % 4 <> 3),
    r AS (SELECT support, sqrt(d2) AS d, row_number() OVER (PARTITION BY support ORDER BY d2, bank_id) AS rank FROM self),
    soft AS (SELECT support, exp(min(d) FILTER (rank = 1) - max(d)) AS first, max(d) AS m FROM r WHERE rank <= 9 GROUP BY support),
    total AS (SELECT r.support, sum(exp(r.d - m)) AS z FROM r JOIN soft USING (support) WHERE rank <= 9 GROUP BY r.support)
    SELECT image_id, {R6('(1 - first / z) * v')} AS score FROM top JOIN soft USING (support) JOIN total USING (support)""")
def patchcore_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _patchcore(spark, sf_dir, 9)
    return model.image_scores(model.patch_scores(test)).select("image_id", r6("score").alias("score"))


_BLUR16 = _gauss_w(16, 9, 1.0, True)


@query(f"""WITH {P}, {_NEAR}, s AS (SELECT image_id, loc // 4 AS y, loc % 4 AS x, sqrt(d2) AS v FROM ranked WHERE rank = 1),
    big AS {_separable('s', _resize_w(16, 4), _resize_w(16, 4))}
    SELECT image_id, y::INT AS y, x::INT AS x, {R6('v')} AS v FROM {_separable('big', _BLUR16, _BLUR16)}""")
def patchcore_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _patchcore(spark, sf_dir, 1)
    return _pixels(model.score(test))


@query(f"""WITH RECURSIVE {P}, b AS (SELECT image_id * 16 + loc AS id, feat FROM p WHERE image_id % 4 <> 3),
    pick AS (
      SELECT 1 AS step, (SELECT min(id) FROM b) AS chosen, (SELECT list(struct_pack(id := q.id, d := CASE WHEN q.id = b.id THEN -1.0 ELSE {_D2} END) ORDER BY q.id) FROM b q, b WHERE b.id = (SELECT min(id) FROM b)) AS least
      UNION ALL
      SELECT step + 1, nxt, (SELECT list(struct_pack(id := u.c.id, d := CASE WHEN u.c.id = nxt OR u.c.d < 0 THEN -1.0 ELSE least(u.c.d, {_D2}) END) ORDER BY u.c.id) FROM unnest(least) AS u(c) JOIN b q ON q.id = u.c.id, b WHERE b.id = nxt)
      FROM (SELECT step, least, (SELECT arg_max(u.c.id, (u.c.d, -u.c.id)) FROM unnest(least) AS u(c)) AS nxt FROM pick) WHERE step < 8)
    SELECT (step - 1)::INT AS pick, chosen AS bank_id FROM pick""")
def coreset_farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = t.bank_rows(t.normal(t.patches(spark, sf_dir)))
    n = bank.count()
    out, _ = core.coreset(bank, 8 / n - 1e-6, project=64, first=0)
    return out.select("pick", "bank_id")


@query()
def random_subset_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = t.bank_rows(t.normal(t.patches(spark, sf_dir)))
    out, _ = core.coreset(bank, 0.1, max_evaluations=10)
    return out.select("bank_id")


# ---- PaDiM -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {P}, n AS (SELECT loc, feat[1] AS a, feat[2] AS b FROM p WHERE image_id % 4 <> 3)
    SELECT loc, count(*) AS n, {R6('sum(a)')} AS s0, {R6('sum(b)')} AS s1, {R6('sum(a * a)')} AS p00, {R6('sum(a * b)')} AS p01, {R6('sum(b * b)')} AS p11 FROM n GROUP BY loc""")
def padim_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PaDiM.moments(t.normal(t.patches(spark, sf_dir)), [0, 1])
    return m.select("loc", "n", *[r6(F.col("sums")[i]).alias(f"s{i}") for i in range(2)], *[r6(F.col("products")[i]).alias(c) for i, c in enumerate(("p00", "p01", "p11"))])


_GAUSS = """n AS (SELECT loc, feat[1] AS a, feat[2] AS b FROM p WHERE image_id % 4 <> 3),
    m AS (SELECT loc, avg(a) AS ma, avg(b) AS mb, sum(a * a) / count(*) - (sum(a) / count(*)) * (sum(a) / count(*)) + 0.01 AS caa,
      sum(a * b) / count(*) - (sum(a) / count(*)) * (sum(b) / count(*)) AS cab, sum(b * b) / count(*) - (sum(b) / count(*)) * (sum(b) / count(*)) + 0.01 AS cbb FROM n GROUP BY loc)"""


@query(f"WITH {P}, {_GAUSS} SELECT loc, {R6('ma')} AS m0, {R6('mb')} AS m1, {R6('caa')} AS c00, {R6('cab')} AS c01, {R6('cbb')} AS c11 FROM m")
def padim_mean_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features.select_channels(t.normal(t.patches(spark, sf_dir)), [0, 1])
    m = stats.location_moments(p, 2)
    g = stats.gaussians(m).join(m.select("loc", "sums"), "loc")
    return g.select("loc", *[r6(F.col("sums")[i] / F.col("n")).alias(f"m{i}") for i in range(2)], *[r6(F.col("covariance")[i]).alias(c) for i, c in ((0, "c00"), (1, "c01"), (3, "c11"))])


_R4 = "floor(({}) * 1e4 + 0.5) / 1e4"


@query(f"""WITH {P}, {_GAUSS}, g AS (SELECT loc, ma::FLOAT AS ma, mb::FLOAT AS mb, (cbb / (caa * cbb - cab * cab))::FLOAT::DOUBLE AS paa, (-cab / (caa * cbb - cab * cab))::FLOAT::DOUBLE AS pab, (caa / (caa * cbb - cab * cab))::FLOAT::DOUBLE AS pbb FROM m),
    d AS (SELECT p.image_id, p.loc, (p.feat[1]::FLOAT - ma)::DOUBLE AS u, (p.feat[2]::FLOAT - mb)::DOUBLE AS v, paa, pab, pbb FROM p JOIN g USING (loc) WHERE image_id % 4 = 3)
    SELECT image_id, loc, {_R4.format('sqrt(greatest(u * (paa * u + pab * v) + v * (pab * u + pbb * v), 0))')} AS v FROM d""")
def padim_distance_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    model = PaDiM.fit(t.normal(p), _OUT, [0, 1])
    return model.patch_scores(t.test(p)).select("image_id", "loc", (F.floor(F.col("v") * 1e4 + 0.5) / 1e4).alias("v"))


@query()
def padim_distance_d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return PaDiM.fit(t.normal(p), _OUT, list(range(0, 64, 8))).patch_scores(t.test(p))


@query()
def padim_distance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return PaDiM.fit(t.normal(p), _OUT, list(range(0, 64, 2))).patch_scores(t.test(p))


@query()
def padim_image_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return PaDiM.fit(t.normal(p), _OUT, [0, 1]).score(t.test(p)).select("image_id", "score", F.size("values").alias("pixels"))


# ---- statistical PatchCore variants, density, retrieval --------------------------------------------------------------


@query()
def mh_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    pca = stats.principal(stats.pooled_moments(t.normal(p), 64), "mh", components=8)
    return stats.whiten(p, pca, ["image_id", "loc"]).select("image_id", "loc", vectors.squared_norm(F.col("feat")).alias("norm2"))


@query()
def mh_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    model = PatchCore.fit(t.normal(p), _OUT, "mh", components=8, bank_size=64, chunk=100)
    return model.bank.select("bank_id", vectors.squared_norm(F.col("feat")).alias("norm2"))


@query()
def mh_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    model = PatchCore.fit(t.normal(p), _OUT, "mh", components=8, bank_size=64, chunk=100)
    return model.image_scores(model.patch_scores(t.test(p)))


@query()
def subad_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return PatchCore.fit(t.normal(p), _OUT, "subad", components=8).patch_scores(p)


@query(f"""WITH {P}, s AS (SELECT image_id, feat[1] AS v, row_number() OVER (PARTITION BY image_id ORDER BY feat[1] DESC) AS r FROM p)
    SELECT image_id, {R6('avg(v)')} AS score FROM s WHERE r <= 4 GROUP BY image_id""")
def subad_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir).select("image_id", F.col("feat")[0].alias("v"))
    return stats.top_fraction_mean(p, 0.2).select("image_id", r6("score").alias("score"))


_D4 = "(q.feat[1] - b.feat[1]) * (q.feat[1] - b.feat[1]) + (q.feat[2] - b.feat[2]) * (q.feat[2] - b.feat[2]) + (q.feat[3] - b.feat[3]) * (q.feat[3] - b.feat[3]) + (q.feat[4] - b.feat[4]) * (q.feat[4] - b.feat[4])"


@query(f"""WITH {P}, d AS (SELECT q.image_id, q.loc, {_D4} AS d2 FROM p q, p b WHERE q.image_id % 4 = 3 AND b.image_id % 4 <> 3),
    m AS (SELECT *, min(d2) OVER (PARTITION BY image_id, loc) AS low FROM d)
    SELECT image_id, loc, {R6('any_value(low) / 2.0 - ln(sum(exp(-(d2 - low) / 2.0)))')} AS v FROM m GROUP BY image_id, loc""")
def dfkde_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    p = t.part(t.patches(spark, sf_dir), 0, 4)
    gallery = knn.matrix(t.normal(p).select("feat").toArrow()["feat"])
    return stats.log_density(t.test(p), np.asarray(gallery), 1.0, ["image_id", "loc"]).withColumn("v", r6("v"))


@query()
def dfkde_pca_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return Dfkde.fit(t.normal(p), _OUT, 16, 1.0).score(t.test(p)).select("image_id", "score")


_SPADE_B = _sum("(q.feat[{i}] - b.feat[{i}]) * (q.feat[{i}] - b.feat[{i}])", 32).replace("feat[", "feat[32 + ")
_SPADE_A = _sum("(q.feat[{i}] - b.feat[{i}]) * (q.feat[{i}] - b.feat[{i}])", 32)
_SPADE = f"""{P}, a AS (SELECT q.image_id, q.loc, {_SPADE_A} AS d2 FROM p q, p b WHERE q.image_id % 4 = 3 AND b.image_id % 4 <> 3),
    b AS (SELECT q.image_id, q.y // 2 * 2 + q.x // 2 AS loc, {_SPADE_B} AS d2 FROM p q, p b WHERE q.image_id % 4 = 3 AND b.image_id % 4 <> 3 AND q.y % 2 = 0 AND q.x % 2 = 0 AND b.y % 2 = 0 AND b.x % 2 = 0),
    s AS (SELECT 'a' AS layer, image_id, loc, avg(sqrt(d2)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY image_id, loc ORDER BY d2) AS r FROM a) WHERE r <= 5 GROUP BY 2, 3
      UNION ALL SELECT 'b', image_id, loc, avg(sqrt(d2)) FROM (SELECT *, row_number() OVER (PARTITION BY image_id, loc ORDER BY d2) AS r FROM b) WHERE r <= 5 GROUP BY 2, 3)"""


def _layers(p: DataFrame) -> dict[str, DataFrame]:
    small = p.where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    half = (F.floor(F.col("y") / 2) * 2 + F.floor(F.col("x") / 2)).cast("int")
    return {"a": t.part(p, 0, 32), "b": t.part(small, 32, 32).withColumn("loc", half)}


def _spade(spark: SparkSession, sf_dir: str) -> tuple[Spade, dict[str, DataFrame]]:
    p = t.patches(spark, sf_dir)
    grids = {"a": Grid(4, 4, 8, 8, 1.0), "b": Grid(2, 2, 8, 8, 1.0)}
    return Spade.fit(_layers(t.normal(p)), grids, 5), _layers(t.test(p))


@query(f"WITH {_SPADE} SELECT layer, image_id, loc::INT AS loc, {R6('v')} AS v FROM s")
def spade_layer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _spade(spark, sf_dir)
    one, two = (model.layer_scores(n, p).select(F.lit(n).alias("layer"), "image_id", F.col("loc").cast("int").alias("loc"), r6("v").alias("v")) for n, p in test.items())
    return one.unionByName(two)


_BLUR8 = _gauss_w(8, 9, 1.0, True)


@query(f"""WITH {_SPADE}, pa AS (SELECT image_id, loc // 4 AS y, loc % 4 AS x, v FROM s WHERE layer = 'a'), pb AS (SELECT image_id, loc // 2 AS y, loc % 2 AS x, v FROM s WHERE layer = 'b'),
    fused AS (SELECT image_id, y, x, avg(v) AS v FROM (SELECT * FROM {_separable('pa', _resize_w(8, 4), _resize_w(8, 4))} UNION ALL SELECT * FROM {_separable('pb', _resize_w(8, 2), _resize_w(8, 2))}) GROUP BY 1, 2, 3)
    SELECT image_id, {R6('max(v)')} AS score FROM {_separable('fused', _BLUR8, _BLUR8)} GROUP BY image_id""")
def spade_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _spade(spark, sf_dir)
    return model.score(test).select("image_id", r6("score").alias("score"))


# ---- EfficientAD, direct, YOLO ---------------------------------------------------------------------------------------

_EFF = f"""{P}, h AS (SELECT image_id, y, x, {_DIFF} AS d, feat[33] AS r FROM p),
    m AS (SELECT image_id, y, x, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS a, (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) AS b FROM h WINDOW w AS (PARTITION BY image_id)),
    e AS (SELECT image_id, max((a + b) / 2) AS score, min((a + b) / 2) AS low FROM m GROUP BY image_id)"""


def _efficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir)
    return EfficientAd(Grid(4, 4, 4, 4, 0.0)).score(t.part(p, 0, 16), t.part(p, 16, 16), t.part(p, 32, 1))


@query(f"WITH {_EFF} SELECT image_id, {R6('score')} AS score FROM e")
def efficientad_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _efficient(spark, sf_dir).select("image_id", r6("score").alias("score"))


@query(f"WITH {_EFF} SELECT count(*) AS sample_count, {R6('min(score)')} AS image_min, {R6('max(score)')} AS image_max, {R6('min(low)')} AS pixel_min, {R6('max(score)')} AS pixel_max FROM e")
def efficientad_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = EfficientAd.fit_range(_efficient(spark, sf_dir))
    return r.select("sample_count", *[r6(c).alias(c) for c in ("image_min", "image_max", "pixel_min", "pixel_max")])


@query(f"WITH {P} SELECT image_id, {R6('max(feat[1])')} AS score, count(*)::INT AS pixels FROM p GROUP BY image_id")
def direct_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.patches(spark, sf_dir).withColumn("v", F.col("feat")[0])
    m = maps.maps_from_pixels(p, 4, 4)
    return Direct.score(maps.map_score(m), m).select("image_id", r6("score").alias("score"), F.size("values").alias("pixels"))


_BOXES = """d AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS anchor,
      CASE WHEN l_tax * 10 > 0 THEN l_linenumber % 2 ELSE 0 END AS class_id, l_tax * 10 AS score, (l_partkey % 48 + 8)::DOUBLE AS cx, (l_suppkey % 48 + 8)::DOUBLE AS cy, l_quantity / 2 + 1 AS s FROM lineitem),
    c AS (SELECT image_id, anchor, class_id::INT AS class_id, score, cx - s / 2 AS x1, cy - s / 2 AS y1, cx + s / 2 AS x2, cy + s / 2 AS y2 FROM d WHERE score >= 0.25)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.candidates(t.detections(spark, sf_dir), 0.25)


@query(f"WITH {_BOXES} SELECT * FROM c")
def yolo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


_IOU = """(greatest(0, least(k.x2, n.x2) - greatest(k.x1, n.x1)) * greatest(0, least(k.y2, n.y2) - greatest(k.y1, n.y1)))
    / ((k.x2 - k.x1) * (k.y2 - k.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - greatest(0, least(k.x2, n.x2) - greatest(k.x1, n.x1)) * greatest(0, least(k.y2, n.y2) - greatest(k.y1, n.y1)))"""
_KEPT = f"""{_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, anchor) AS r FROM c),
    walk AS (SELECT image_id, class_id, r, true AS keep, [anchor] AS held FROM o WHERE r = 1
      UNION ALL SELECT n.image_id, n.class_id, n.r, f.ok, CASE WHEN f.ok THEN list_append(w.held, n.anchor) ELSE w.held END
      FROM walk w JOIN o n ON n.image_id = w.image_id AND n.class_id = w.class_id AND n.r = w.r + 1,
      LATERAL (SELECT NOT EXISTS (SELECT 1 FROM o k WHERE k.image_id = n.image_id AND k.class_id = n.class_id AND list_contains(w.held, k.anchor) AND {_IOU} > 0.05) AS ok) f),
    kept AS (SELECT o.* EXCLUDE (r) FROM o JOIN walk w ON w.image_id = o.image_id AND w.class_id = o.class_id AND w.r = o.r WHERE w.keep)"""


@query(f"WITH RECURSIVE {_KEPT} SELECT * FROM kept")
def yolo_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.suppress(_candidates(spark, sf_dir), 0.05)


@query(f"""WITH RECURSIVE {_KEPT}, px AS (SELECT image_id, y, x, min(score) AS v FROM (SELECT image_id, score, unnest(range(greatest(floor(y1), 0)::INT, least(ceil(y2), 64)::INT)) AS y, x1, x2 FROM kept), LATERAL (SELECT unnest(range(greatest(floor(x1), 0)::INT, least(ceil(x2), 64)::INT)) AS x) GROUP BY 1, 2, 3)
    SELECT i.image_id, coalesce(k.score, 0.0) AS score, coalesce(p.n, 0) AS painted, {R6('coalesce(p.s, 0.0)')} AS total FROM (SELECT DISTINCT l_orderkey AS image_id FROM lineitem) i
    LEFT JOIN (SELECT image_id, max(score) AS score FROM kept GROUP BY 1) k USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n, sum(v) AS s FROM px GROUP BY 1) p USING (image_id)""")
def yolo_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id")).distinct()
    raw = Yolo(64, 64, 2, 0.25, 0.05).totals(t.detections(spark, sf_dir), images)
    return raw.select("image_id", "score", "painted", r6("total").alias("total"))


# ---- postprocessing --------------------------------------------------------------------------------------------------

_NORM = "least(greatest((v - 0.4) / (0.9 - 0.1) + 0.5, 0), 1)"


@query(f"WITH {GRID} SELECT image_id, y, x, {R6(_NORM)} AS v FROM g")
def normalize_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(post.normalize_map(t.grids(spark, sf_dir), 0.4, 0.1, 0.9))


@query(f"WITH {GRID}, s AS (SELECT image_id, max(v) AS v FROM g WHERE y < 6 AND x < 6 GROUP BY 1) SELECT image_id, {R6(_NORM)} AS score, {_NORM} >= 1 - 0.25 AS is_anomalous FROM s")
def image_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = maps.pixels_of(t.grids(spark, sf_dir)).where("y < 6 and x < 6")
    raw = px.groupBy("image_id").agg(F.max("v").alias("score")).select("image_id", "score", F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("array<double>").alias("values"))
    cfg = post.Config(image_threshold=0.4, image_min=0.1, image_max=0.9, image_sensitivity=0.25)
    return post.postprocess(raw, None, cfg).select("image_id", r6("score").alias("score"), "is_anomalous")


@query(f"WITH {GRID} SELECT image_id, y, x, CASE WHEN v >= 0.6 THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM g")
def threshold_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(post.threshold_mask(t.grids(spark, sf_dir), 0.6))


_B12 = _gauss_w(12, 9, 1.0, True)


@query(f"WITH {GRID} SELECT image_id, y::INT AS y, x::INT AS x, {R6('v')} AS v FROM {_separable('g', _B12, _B12)}")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(maps.blur_map(t.grids(spark, sf_dir), 1.0))


_S12 = _gauss_w(12, 5, 1.1, False)


@query(f"WITH {GRID} SELECT image_id, y::INT AS y, x::INT AS x, {R6('v')} AS v FROM {_separable('g', _S12, _S12)}")
def smooth_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(maps.smooth_map(t.grids(spark, sf_dir), 5, 1.1))


def _morph_sql(first: str, second: str) -> str:
    step = "SELECT a.image_id, a.y, a.x, {}(b.v) AS v FROM {} a JOIN {} b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3"
    return f"WITH {GRID}, m AS (SELECT image_id, y, x, CASE WHEN v >= 0.6 THEN 255.0 ELSE 0.0 END::DOUBLE AS v FROM g), one AS ({step.format(first, 'm', 'm')}), two AS ({step.format(second, 'one', 'one')}) SELECT * FROM two"


@query(_morph_sql("min", "max"))
def morph_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(maps.morph(post.threshold_mask(t.grids(spark, sf_dir), 0.6), 3, 1, "open"))


@query(_morph_sql("max", "min"))
def morph_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(maps.morph(post.threshold_mask(t.grids(spark, sf_dir), 0.6), 3, 1, "close"))


_COMP = f"""{GRID}, m AS (SELECT image_id, y, x, v, y * 12 + x AS i FROM g WHERE v >= 0.8),
    adj AS (SELECT a.image_id, a.i AS a, b.i AS b FROM m a JOIN m b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach AS (SELECT image_id, i, i AS r FROM m UNION SELECT reach.image_id, reach.i, adj.b FROM reach JOIN adj ON adj.image_id = reach.image_id AND adj.a = reach.r),
    lab AS (SELECT image_id, i, min(r) AS first FROM reach GROUP BY 1, 2),
    reg AS (SELECT m.image_id, first, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, arg_max(x, (v, -m.i)) AS max_x, arg_max(y, (v, -m.i)) AS max_y, count(*)::DOUBLE AS area, avg(v) AS mean_score, max(v) AS max_score
      FROM m JOIN lab ON lab.image_id = m.image_id AND lab.i = m.i GROUP BY 1, 2)"""


def _masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = t.grids(spark, sf_dir)
    return g, post.threshold_mask(g, 0.8)


@query(f"WITH RECURSIVE {_COMP} SELECT m.image_id, m.y, m.x, dense_rank() OVER (PARTITION BY m.image_id ORDER BY first)::DOUBLE AS v FROM m JOIN lab ON lab.image_id = m.image_id AND lab.i = m.i")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(maps.label_map(_masked(spark, sf_dir)[1])).where("v > 0")


@query(f"""WITH RECURSIVE {_COMP} SELECT image_id, x::INT AS x, y::INT AS y, width::INT AS width, height::INT AS height, max_x::INT AS max_x, max_y::INT AS max_y, area, {R6('mean_score')} AS mean_score, max_score FROM
    (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, first) AS n FROM reg WHERE area >= 2) WHERE n <= 5""")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, mask = _masked(spark, sf_dir)
    return post.region_rows(post.regions(g, mask, 2, 5)).withColumn("mean_score", r6("mean_score"))


@query(f"""WITH RECURSIVE {_COMP}, top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, first) AS n FROM reg WHERE area >= 2),
    s AS (SELECT image_id, count(*) AS region_count, avg(mean_score) AS mean_score, max(max_score) AS max_score FROM top WHERE n <= 5 GROUP BY 1)
    SELECT g.image_id, {R6('sum((v >= 0.8)::INT) / 144.0::DOUBLE')} AS area_ratio, coalesce(any_value(region_count), 0)::INT AS region_count, {R6('coalesce(any_value(mean_score), 0)')} AS mean_score, coalesce(any_value(max_score), 0)::DOUBLE AS max_score, true AS has_map
    FROM g LEFT JOIN s ON s.image_id = g.image_id GROUP BY g.image_id""")
def image_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, mask = _masked(spark, sf_dir)
    a = post.regions(g, mask, 2, 5)
    return a.select("image_id", r6("area_ratio").alias("area_ratio"), "region_count", r6("mean_score").alias("mean_score"), "max_score", "has_map")


@query(f"""WITH {GRID}, c AS {_separable('g', _resize_w(6, 12), _resize_w(6, 12))},
    canvas AS (SELECT i.image_id, a.y, b.x, coalesce(c.v, 0.0) AS v FROM (SELECT DISTINCT image_id FROM g) i, range(8) AS a(y), range(8) AS b(x) LEFT JOIN c ON c.image_id = i.image_id AND c.y = a.y - 1 AND c.x = b.x - 1)
    SELECT image_id, y::INT AS y, x::INT AS x, floor(v * 1e8 + 0.5) / 1e8 AS v FROM {_separable('canvas', _resize_w(10, 8), _resize_w(16, 8))}""")
def geometry_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.grids(spark, sf_dir)
    size = {"original_w": 16, "original_h": 10, "resized_w": 8, "resized_h": 8, "crop_x": 1, "crop_y": 1, "crop_w": 6, "crop_h": 6}
    out = post.restore_geometry(g, g.select("image_id", *[F.lit(v).alias(k) for k, v in size.items()]))
    return maps.pixels_of(out).withColumn("v", F.floor(F.col("v") * 1e8 + 0.5) / 1e8)  # exact ties at six decimals


# ---- calibration, wide workloads, catalogue, streams -----------------------------------------------------------------


def _calibration_sql(src: str) -> str:
    return f"""SELECT n AS sample_count, {R6('CASE WHEN hi > lo THEN lo ELSE lo - greatest(1e-6, abs(lo) * 1e-6) END')} AS low, {R6('CASE WHEN hi > lo THEN hi ELSE hi + greatest(1e-6, abs(lo) * 1e-6) END')} AS high,
    {R6('l[floor((1 - 0.01::FLOAT::DOUBLE) * (n - 1))::BIGINT + 1]')} AS threshold FROM (SELECT count(v) AS n, min(v) AS lo, max(v) AS hi, list(v ORDER BY v) AS l FROM {src})"""


def _calibrated(spark: SparkSession, row, kind: str) -> DataFrame:
    one = spark.createDataFrame([(row["sample_count"], row[f"{kind}_min"], row[f"{kind}_max"], row[f"{kind}_threshold"])], "sample_count long, low double, high double, threshold double")
    return one.select("sample_count", *[r6(c).alias(c) for c in ("low", "high", "threshold")])


@query(f"WITH {GRID}, s AS (SELECT image_id, max(v) AS v FROM g WHERE y < 6 AND x < 6 GROUP BY 1) {_calibration_sql('s')}")
def calibrate_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = maps.pixels_of(t.grids(spark, sf_dir)).where("y < 6 and x < 6")
    raw = px.groupBy("image_id").agg(F.max("v").alias("score")).withColumn("values", F.lit(None).cast("array<double>"))
    return _calibrated(spark, cal.calibrate(raw), "image")


@query(f"WITH {GRID} SELECT (SELECT count(DISTINCT image_id) FROM g) AS sample_count, low, high, threshold FROM ({_calibration_sql('g')})")
def calibrate_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.grids(spark, sf_dir).withColumn("score", F.array_max("values"))
    return _calibrated(spark, cal.calibrate(g), "pixel")


@query(f"""WITH w AS (SELECT (l_linenumber - 1)::INT AS loc, l_quantity / 50 AS a, l_extendedprice / 100000 AS b FROM lineitem),
    m AS (SELECT loc, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a * a) - avg(a) * avg(a) + 0.01 AS caa, avg(a * b) - avg(a) * avg(b) AS cab, avg(b * b) - avg(b) * avg(b) + 0.01 AS cbb FROM w GROUP BY loc),
    g AS (SELECT loc, ma::FLOAT AS ma, mb::FLOAT AS mb, (cbb / (caa * cbb - cab * cab))::FLOAT::DOUBLE AS paa, (-cab / (caa * cbb - cab * cab))::FLOAT::DOUBLE AS pab, (caa / (caa * cbb - cab * cab))::FLOAT::DOUBLE AS pbb FROM m),
    d AS (SELECT loc, (a::FLOAT - ma)::DOUBLE AS u, (b::FLOAT - mb)::DOUBLE AS v, paa, pab, pbb FROM w JOIN g USING (loc))
    SELECT loc, count(*) AS n, {_R4.format('avg(sqrt(greatest(u * (paa * u + pab * v) + v * (pab * u + pbb * v), 0)))')} AS mean_distance FROM d GROUP BY loc""")
def wide_padim_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = t.wide(spark, sf_dir)
    model = PaDiM.fit(w, _OUT, [0, 1])
    d = stats.mahalanobis(features.select_channels(w, [0, 1]), model.gauss, ["loc"])
    return d.groupBy("loc").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.avg("v") * 1e4 + 0.5) / 1e4).alias("mean_distance"))


@query(f"""WITH w AS (SELECT (l_linenumber - 1)::INT AS loc, l_extendedprice AS v FROM lineitem), s AS (SELECT loc, count(*) AS n, min(v) AS low, max(v) AS high, list(v ORDER BY v) AS l FROM w GROUP BY loc)
    SELECT loc, n, low, high, l[floor((1 - 0.01::FLOAT::DOUBLE) * (n - 1))::BIGINT + 1] AS threshold FROM s""")
def wide_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t.read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("loc"), F.col("l_extendedprice").alias("v"))
    return cal.calibrate_groups(li, ["loc"], "v")


@query("SELECT * FROM (VALUES ('patchcore', 'feature_pyramid', true, true), ('padim', 'feature_pyramid', true, true), ('dfkde', 'feature_pyramid', false, true), ('spade', 'feature_pyramid', false, true), ('efficientad', 'prediction', false, true), ('direct', 'prediction', false, true), ('yolo', 'prediction', false, true)) AS t(algorithm, contract, public_fit, has_map)")
def manifest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .algorithms import CATALOGUE

    return spark.createDataFrame(CATALOGUE, "algorithm string, contract string, public_fit boolean, has_map boolean")


@query("SELECT item_id, sha256(text) AS sha256 FROM benchmark")
def artifact_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(f"SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, {R6('avg(value)')} AS mean, {R6('var_pop(value)')} AS variance FROM events GROUP BY event_type")
def stream_minmax_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.incremental import fit_stream

    out = fit_stream(spark, t.read(spark, sf_dir, "events").schema, f"{sf_dir}/events.parquet", "event_type", "value")
    return out.select("event_type", "n", "low", "high", r6("mean").alias("mean"), r6("variance").alias("variance"))
