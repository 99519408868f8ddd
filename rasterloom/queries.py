"""Registered queries over rasters and requests derived from the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pixels as P
from .functions.geometry import contain, cover
from .operators import normalize, resample, rows
from .operators.deal import dealt
from .plans import admission

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- fixtures: rasters and requests of whole tables ----------------------------------------------

# Request fixture, in SQL: dimensions and options from every line item.
REQUESTS_SQL = """req AS (SELECT l_orderkey * 10 + l_linenumber AS request_id,
  1 + l_partkey * 37 % 6000 AS width, 1 + l_suppkey * 91 % 6000 AS height, 1 + l_orderkey * 7 % 900 AS max_box_width, 1 + l_orderkey * 11 % 700 AS max_box_height,
  CASE WHEN l_linenumber % 2 = 0 THEN 'cover' ELSE 'contain' END AS fit, l_linenumber % 3 = 0 AS allow_upscale,
  CASE l_linenumber % 3 WHEN 0 THEN 'rgba' WHEN 1 THEN 'png' ELSE 'jpeg' END AS output,
  CASE l_linenumber WHEN 1 THEN 'grayscale' WHEN 2 THEN 'indexed' WHEN 3 THEN 'rgb' WHEN 4 THEN 'rgba' WHEN 5 THEN 'grayscale-alpha' WHEN 6 THEN 'grayscale' ELSE 'rgb' END AS color_type,
  CASE l_linenumber WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 8 WHEN 5 THEN 16 WHEN 6 THEN 16 ELSE 8 END AS bit_depth,
  l_orderkey % 4 = 0 AS interlaced, l_orderkey * 97 % 70000000 AS encoded_bytes FROM lineitem)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("bigint")
    ok, pk, sk = (F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    return li.select(
        (ok * 10 + n).alias("request_id"), (1 + pk * 37 % 6000).alias("width"), (1 + sk * 91 % 6000).alias("height"),
        (1 + ok * 7 % 900).alias("max_box_width"), (1 + ok * 11 % 700).alias("max_box_height"),
        F.when(n % 2 == 0, "cover").otherwise("contain").alias("fit"), (n % 3 == 0).alias("allow_upscale"),
        F.when(n % 3 == 0, "rgba").when(n % 3 == 1, "png").otherwise("jpeg").alias("output"),
        pick(["grayscale", "indexed", "rgb", "rgba", "grayscale-alpha", "grayscale", "rgb"]).alias("color_type"),
        pick([4, 8, 16, 8, 16, 16, 8]).cast("bigint").alias("bit_depth"), (ok % 4 == 0).alias("interlaced"), (ok * 97 % 70000000).alias("encoded_bytes"),
    )


def _folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors see; a temporary one only where none is configured and they run in this process."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/{kind}-{uuid.uuid4().hex}"


def emb_pixels(spark: SparkSession, sf_dir: str, height: int, ow: int, oh: int, fit: str) -> DataFrame:
    """The embeddings as gray rasters 64 wide of `height` rows each; a row without a vector is transparent black."""
    e = _table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    vectors = e.select(P.div(F.col("vec_id"), height).alias("image_id"), (F.col("vec_id") % height).alias("y"), F.coalesce(F.col("label"), F.lit(0)).cast("bigint").alias("label"), "embedding")
    lacking = vectors.groupBy("image_id").agg(F.collect_set("y").alias("has")).select("image_id", F.explode(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(height - 1).cast("bigint")), F.col("has"))).alias("y"))
    px = vectors.select("image_id", "y", "label", F.posexplode("embedding").alias("x", "v"))
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 127.5))).cast("bigint")
    px = px.select("image_id", "y", F.col("x").cast("bigint").alias("x"), gray.alias("r"), (255 - gray).alias("g"), (gray * 3 % 256).alias("b"), (255 - 50 * (F.col("label") % 3)).alias("a"))
    zero = F.lit(0).cast("bigint")
    clear = lacking.select("image_id", "y", F.explode(F.sequence(zero, F.lit(63).cast("bigint"))).alias("x"), *[zero.alias(c) for c in "rgba"])
    size = {"width": 64, "height": height, "out_width": ow, "out_height": oh}
    return px.unionByName(clear).withColumns({k: F.lit(v).cast("bigint") for k, v in size.items()}).withColumn("fit", F.lit(fit))


def _emb_sql(height: int) -> str:
    return f"""v AS (SELECT vec_id // {height} AS image_id, vec_id % {height} AS y, label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
px AS (SELECT image_id, y, x, g0 AS r, 255 - g0 AS g, g0 * 3 % 256 AS b, 255 - 50 * (coalesce(label, 0) % 3) AS a FROM (
  SELECT image_id, y, label, i AS x, CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS g0 FROM (
    SELECT image_id, y, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM v))
  UNION ALL SELECT image_id, y, x, 0, 0, 0, 0 FROM (SELECT DISTINCT image_id FROM v), range({height}) t(y), range(64) u(x) WHERE (image_id, y) NOT IN (SELECT (image_id, y) FROM v))"""


def _axis_sql(name: str, n: int, cell: int, start: int, stop: int, span: int) -> str:
    return f"""{name} AS (SELECT i, o, least(b, {start} + (o + 1) * {span}) - greatest(a, {start} + o * {span}) AS w FROM (
  SELECT i, a, b, unnest(range((a - {start}) // {span}, (b - {start} + {span} - 1) // {span})) AS o FROM (
    SELECT i, greatest(i * {cell}, {start}) AS a, least((i + 1) * {cell}, {stop}) AS b FROM range({n}) t(i)) WHERE a < b))"""


def _lattice(fit: str, sw: int, sh: int, ow: int, oh: int) -> tuple[tuple[int, int, int, int], tuple[int, int, int, int]]:
    """What the SQL's literals are: (cell, start, stop, span) of x and y."""
    x, y = (ow, 0, sw * ow, sw), (oh, 0, sh * oh, sh)
    if fit == "cover" and sw * oh > sh * ow:
        x = (2 * oh, sw * oh - sh * ow, sw * oh + sh * ow, 2 * sh)
    if fit == "cover" and sw * oh < sh * ow:
        y = (2 * ow, sh * ow - sw * oh, sh * ow + sw * oh, 2 * sw)
    return x, y


def _area_sql(height: int, ow: int, oh: int, fit: str, final: str | None = None) -> str:
    x, y = _lattice(fit, 64, height, ow, oh)
    rnd = lambda n, d: f"({n} // {d} + CASE WHEN 2 * ({n} % {d}) >= {d} THEN 1 ELSE 0 END)"
    color = lambda s: f"CASE WHEN sa = 0 THEN 0 ELSE {rnd(s, 'sa')} END::BIGINT"
    return f"""WITH {_emb_sql(height)}, {_axis_sql('ax', 64, *x)}, {_axis_sql('ay', height, *y)},
s AS (SELECT image_id, ay.o AS oy, ax.o AS ox, sum(ax.w * ay.w) AS w, sum(a * ax.w * ay.w) AS sa, sum(r * a * ax.w * ay.w) AS sr, sum(g * a * ax.w * ay.w) AS sg, sum(b * a * ax.w * ay.w) AS sb
  FROM px JOIN ax ON px.x = ax.i JOIN ay ON px.y = ay.i GROUP BY 1, 2, 3)
{final or f"SELECT image_id, oy, ox, {color('sr')} AS r, {color('sg')} AS g, {color('sb')} AS b, {rnd('sa', 'w')}::BIGINT AS a FROM s"}"""


# ---- geometry, limits, memory --------------------------------------------------------------------

_CONTAIN_SQL = """CASE WHEN bw * height <= bh * width THEN bw ELSE greatest(1, width * bh // height) END AS out_width,
  CASE WHEN bw * height <= bh * width THEN greatest(1, height * bw // width) ELSE bh END AS out_height"""
_COVER_SQL = """CASE WHEN allow_upscale OR (width >= max_box_width AND height >= max_box_height) THEN max_box_width WHEN width * max_box_height <= height * max_box_width THEN width ELSE greatest(1, max_box_width * height // max_box_height) END AS out_width,
  CASE WHEN allow_upscale OR (width >= max_box_width AND height >= max_box_height) THEN max_box_height WHEN width * max_box_height <= height * max_box_width THEN greatest(1, max_box_height * width // max_box_width) ELSE height END AS out_height"""
_BOXED = "boxed AS (SELECT *, CASE WHEN allow_upscale THEN max_box_width ELSE least(max_box_width, width) END AS bw, CASE WHEN allow_upscale THEN max_box_height ELSE least(max_box_height, height) END AS bh FROM req)"


@_register("geometry_contain", f"WITH {REQUESTS_SQL}, {_BOXED} SELECT request_id, {_CONTAIN_SQL} FROM boxed")
def geometry_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = contain(*(F.col(c) for c in ("width", "height", "max_box_width", "max_box_height", "allow_upscale")))
    return requests(spark, sf_dir).select("request_id", w.alias("out_width"), h.alias("out_height"))


@_register("geometry_cover", f"WITH {REQUESTS_SQL} SELECT request_id, {_COVER_SQL} FROM req")
def geometry_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = cover(*(F.col(c) for c in ("width", "height", "max_box_width", "max_box_height", "allow_upscale")))
    return requests(spark, sf_dir).select("request_id", w.alias("out_width"), h.alias("out_height"))


# Limits of the fixture, tight enough for each to reject some request.
_FIXTURE_LIMITS = {"max_input_bytes": 60_000_000, "max_width": 5500, "max_height": 5600, "max_pixels": 20_000_000, "max_output_width": 880, "max_output_height": 680, "max_output_pixels": 500_000, "max_working_memory_bytes": 4_000_000}


def planned(spark: SparkSession, sf_dir: str, writer: bool = False, adapter: int = 0, sparse: bool | None = None, enforce: bool = True) -> DataFrame:
    r = requests(spark, sf_dir).withColumns({"source_bpp": P.planning_bytes_per_pixel(F.col("color_type"), F.col("bit_depth")), "writer": F.lit(writer), "adapter_bytes": F.lit(adapter).cast("bigint")})
    if sparse is not None:
        r = r.withColumn("interlaced", F.lit(sparse))
    return admission.plan(r.withColumns({f"limit_{k}": F.lit(v).cast("bigint") for k, v in _FIXTURE_LIMITS.items()}), enforce)


_BPP_SQL = "CASE WHEN color_type = 'indexed' OR (color_type = 'grayscale' AND bit_depth < 8) THEN 1 ELSE (CASE color_type WHEN 'grayscale' THEN 1 WHEN 'grayscale-alpha' THEN 2 WHEN 'rgb' THEN 3 ELSE 4 END) * (bit_depth // 8) END"


def _plan_sql(final: str, writer: bool = False, adapter: int = 0, sparse: bool | None = None) -> str:
    il = "interlaced" if sparse is None else str(sparse).upper()
    cap = "CASE output WHEN 'png' THEN (4 * ow * oh + oh) + (4 * ow * oh + oh) // 8 + 65536 WHEN 'jpeg' THEN ((ow + 7) // 8) * ((oh + 7) // 8) * 3 * 420 + 65536 ELSE 0 END"
    lim = _FIXTURE_LIMITS
    contained, covered = _CONTAIN_SQL.replace("out_", "c_"), _COVER_SQL.replace("out_", "v_")
    return f"""WITH {REQUESTS_SQL}, {_BOXED}, s AS (SELECT *, {contained}, {covered} FROM boxed),
z AS (SELECT *, {_BPP_SQL} AS bpp, CASE fit WHEN 'cover' THEN v_width ELSE c_width END AS ow, CASE fit WHEN 'cover' THEN v_height ELSE c_height END AS oh FROM s),
m AS (SELECT *, 3 * (width * bpp + 1) AS decoder_rows_bytes, 163840 AS decoder_staging_bytes, 4 * width AS normalized_row_bytes, CASE WHEN {il} THEN 0 ELSE 80 * ow END AS horizontal_bytes, CASE WHEN {il} THEN 0 ELSE 80 * ow END AS vertical_bytes,
  CASE WHEN {il} THEN 80 * ow * oh ELSE 0 END AS sparse_bytes, 4 * ow AS output_row_bytes, CASE output WHEN 'rgba' THEN 4 * ow * oh ELSE 0 END AS output_rgba_bytes,
  CASE output WHEN 'png' THEN 131072 WHEN 'jpeg' THEN 65536 + 240 * ow + (((ow + 7) // 8) * 2520 + 65536) ELSE 0 END AS encoder_state_bytes, {adapter if writer else cap} AS encoded_output_bytes, {cap} AS encoded_cap FROM z),
t AS (SELECT *, decoder_rows_bytes + decoder_staging_bytes + normalized_row_bytes + horizontal_bytes + vertical_bytes + sparse_bytes + output_row_bytes + output_rgba_bytes + encoder_state_bytes + encoded_output_bytes AS total_bytes FROM m),
k AS (SELECT *, CASE WHEN encoded_bytes > {lim['max_input_bytes']} THEN 'LimitExceeded.InputBytes' WHEN width > {lim['max_width']} THEN 'LimitExceeded.InputWidth' WHEN height > {lim['max_height']} THEN 'LimitExceeded.InputHeight'
  WHEN width * height > {lim['max_pixels']} THEN 'LimitExceeded.InputPixels' WHEN ow > {lim['max_output_width']} THEN 'LimitExceeded.OutputWidth' WHEN oh > {lim['max_output_height']} THEN 'LimitExceeded.OutputHeight'
  WHEN ow * oh > {lim['max_output_pixels']} THEN 'LimitExceeded.OutputPixels' WHEN total_bytes > {lim['max_working_memory_bytes']} THEN 'LimitExceeded.WorkingMemory' END AS error_kind FROM t)
{final}"""


_MEMORY = "decoder_rows_bytes, decoder_staging_bytes, normalized_row_bytes, horizontal_bytes, vertical_bytes, sparse_bytes, output_row_bytes, output_rgba_bytes, encoder_state_bytes, encoded_output_bytes, encoded_cap, total_bytes".split(", ")
_MEMORY_SQL = "SELECT request_id, " + ", ".join(f"{m}::BIGINT AS {m}" for m in _MEMORY) + " FROM k"


@_register("memory_plan_ordered", _plan_sql(_MEMORY_SQL, sparse=False))
def memory_plan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir, sparse=False).select("request_id", *_MEMORY)


@_register("memory_plan_sparse", _plan_sql(_MEMORY_SQL, sparse=True))
def memory_plan_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir, sparse=True).select("request_id", *_MEMORY)


@_register("memory_plan_writer", _plan_sql(_MEMORY_SQL, writer=True, adapter=65536))
def memory_plan_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir, writer=True, adapter=65536).select("request_id", *_MEMORY)


_ACTUAL = """CASE error_kind WHEN 'LimitExceeded.InputBytes' THEN encoded_bytes WHEN 'LimitExceeded.InputWidth' THEN width WHEN 'LimitExceeded.InputHeight' THEN height WHEN 'LimitExceeded.InputPixels' THEN width * height
  WHEN 'LimitExceeded.OutputWidth' THEN ow WHEN 'LimitExceeded.OutputHeight' THEN oh WHEN 'LimitExceeded.OutputPixels' THEN ow * oh WHEN 'LimitExceeded.WorkingMemory' THEN total_bytes END"""


@_register("limits_first_violation", _plan_sql(f"SELECT request_id, error_kind, {_ACTUAL}::BIGINT AS actual FROM k"))
def limits_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select("request_id", "error_kind", "actual")


@_register("zero_limits", f"""WITH {REQUESTS_SQL}, z AS (SELECT request_id, request_id % 7 AS z FROM req)
SELECT request_id, CASE z WHEN 0 THEN 'LimitExceeded.InputBytes' WHEN 1 THEN 'InvalidLimit.max_width' WHEN 2 THEN 'InvalidLimit.max_pixels' WHEN 3 THEN 'InvalidLimit.max_working_memory_bytes' WHEN 4 THEN 'ZeroDimension.height' WHEN 5 THEN 'ZeroDimension.max_box_width' END AS error_kind FROM z""")
def zero_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits, images and boxes that are zero: the byte limit is told before limits that are none, those before empty images, and these before empty boxes."""
    z = F.col("request_id") % 7
    r = requests(spark, sf_dir).withColumns({"encoded_bytes": F.lit(10).cast("bigint"), "source_bpp": F.lit(4).cast("bigint"), "interlaced": F.lit(False), "writer": F.lit(False), "adapter_bytes": F.lit(0).cast("bigint"), "width": F.lit(8).cast("bigint"), "allow_upscale": F.lit(False)})
    r = r.withColumns({"height": F.when(z == 4, 0).otherwise(6).cast("bigint"), "max_box_width": F.when(z == 5, 0).otherwise(4).cast("bigint"), "max_box_height": F.lit(4).cast("bigint")})
    zero = {"max_input_bytes": z == 0, "max_width": (z == 0) | (z == 1), "max_pixels": z == 2, "max_working_memory_bytes": z == 3}
    names = ("max_input_bytes", "max_width", "max_height", "max_pixels", "max_output_width", "max_output_height", "max_output_pixels", "max_working_memory_bytes")
    r = r.withColumns({f"limit_{n}": F.when(zero.get(n, F.lit(False)), 0).otherwise(1 << 30).cast("bigint") for n in names})
    return admission.plan(r).select("request_id", "error_kind")


@_register("preflight", _plan_sql(f"SELECT request_id, ow AS out_width, oh AS out_height, total_bytes <= {_FIXTURE_LIMITS['max_working_memory_bytes']} AS within_memory_limit, CASE WHEN error_kind = 'LimitExceeded.WorkingMemory' THEN NULL ELSE error_kind END AS error_kind FROM k"))
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir, enforce=False).select("request_id", "out_width", "out_height", "within_memory_limit", "error_kind")


@_register("admission_summary", _plan_sql("SELECT coalesce(error_kind, 'admitted') AS verdict, output, count(*) AS n, sum(total_bytes)::BIGINT AS total_bytes FROM k GROUP BY 1, 2"))
def admission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).groupBy(F.coalesce("error_kind", F.lit("admitted")).alias("verdict"), "output").agg(F.count("*").alias("n"), F.sum("total_bytes").alias("total_bytes"))


@_register("planning_bpp", f"WITH {REQUESTS_SQL} SELECT request_id, ({_BPP_SQL})::BIGINT AS source_bpp FROM req")
def planning_bpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("request_id", P.planning_bytes_per_pixel(F.col("color_type"), F.col("bit_depth")).alias("source_bpp"))


@_register("valid_depth", f"""WITH {REQUESTS_SQL}, d AS (SELECT request_id, color_type, CASE (width + height) % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 16 ELSE 3 END AS depth FROM req)
SELECT color_type, depth, count(*) AS n FROM d WHERE (color_type = 'grayscale' AND depth IN (1, 2, 4, 8, 16)) OR (color_type = 'indexed' AND depth IN (1, 2, 4, 8)) OR (color_type IN ('grayscale-alpha', 'rgb', 'rgba') AND depth IN (8, 16)) GROUP BY 1, 2""")
def valid_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("width") + F.col("height")) % 6
    d = requests(spark, sf_dir).withColumn("depth", F.when(k == 0, 1).when(k == 1, 2).when(k == 2, 4).when(k == 3, 8).when(k == 4, 16).otherwise(3))
    return d.where(P.valid_depth(F.col("color_type"), F.col("depth"))).groupBy("color_type", "depth").agg(F.count("*").alias("n"))


@_register("mime_types", f"WITH {REQUESTS_SQL} SELECT CASE output WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime_type, count(*) AS n FROM req GROUP BY 1")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).groupBy(P.mime_type(F.col("output")).alias("mime_type")).agg(F.count("*").alias("n"))


@_register("auto_color", """WITH e AS (SELECT vec_id, label, list_transform(range(1, 5), lambda i: CAST(floor(abs(embedding[i]) * 255) AS BIGINT)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL),
k AS (SELECT vec_id, CASE label % 5 WHEN 0 THEN 'grayscale' WHEN 1 THEN 'grayscale-alpha' WHEN 2 THEN 'rgb' WHEN 3 THEN 'rgba' ELSE 'indexed' END AS color_type, vec_id % 3 = 0 AS has_trns, vec_id % 2 = 0 AS gray, q[1] % 4 = 0 AS clear FROM e)
SELECT vec_id, CASE color_type WHEN 'grayscale' THEN CASE WHEN has_trns THEN 'grayscale-alpha8' ELSE 'grayscale8' END WHEN 'grayscale-alpha' THEN 'grayscale-alpha8' WHEN 'rgb' THEN CASE WHEN has_trns THEN 'rgba8' ELSE 'rgb8' END WHEN 'rgba' THEN 'rgba8'
  ELSE CASE WHEN gray AND NOT clear THEN 'grayscale8' WHEN gray THEN 'grayscale-alpha8' WHEN clear THEN 'rgba8' ELSE 'rgb8' END END AS auto_color FROM k""")
def auto_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL")
    q = F.transform(F.slice("embedding", 1, 4), lambda v: F.floor(F.abs(v) * 255))
    e = e.withColumns({"q": q, "k": F.col("label") % 5})
    gray = F.col("vec_id") % 2 == 0
    entry = lambda v: F.struct(v.alias("r"), v.alias("g"), F.when(gray, v).otherwise(v + 1).alias("b"))
    kinds = F.when(F.col("k") == 0, "grayscale").when(F.col("k") == 1, "grayscale-alpha").when(F.col("k") == 2, "rgb").when(F.col("k") == 3, "rgba").otherwise("indexed")
    alphas = F.array(F.lit(255), F.when(F.col("q")[0] % 4 == 0, 128).otherwise(255))
    return e.select("vec_id", P.auto_color(kinds, F.col("vec_id") % 3 == 0, F.transform("q", entry), alphas).alias("auto_color"))


# ---- resampling ----------------------------------------------------------------------------------

AREAS = {
    "area_contain": (50, 23, 17, "contain"),
    "area_cover": (50, 16, 24, "cover"),
    "area_cover_wide": (100, 30, 20, "cover"),
    "area_upscale": (20, 100, 31, "contain"),
    "area_identity": (10, 64, 10, "contain"),
}


def _area(height: int, ow: int, oh: int, fit: str) -> Query:
    return lambda spark, sf_dir: resample.resample(emb_pixels(spark, sf_dir, height, ow, oh, fit))


for _name, _spec in AREAS.items():
    _register(_name, _area_sql(*_spec))(_area(*_spec))


@_register("area_two_stage", _area_sql(50, 23, 17, "contain"))
def area_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.pixel_of(resample.cell_sums_by_rows(emb_pixels(spark, sf_dir, 50, 23, 17, "contain")))


@_register("area_wide_sums", _area_sql(50, 16, 24, "cover"))
def area_wide_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(emb_pixels(spark, sf_dir, 50, 16, 24, "cover"), wide=True)


def _event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one sparse raster 50 wide, in order of time and so in no order of place. The rest of the last line is transparent black."""
    e = _table(spark, sf_dir, "events").where("event_id IS NOT NULL")
    n = e.agg(F.max("event_id").alias("m")).select((P.div(F.col("m"), 50) + 1).alias("height"), "m")
    i = F.col("event_id")
    a = F.when(i % 11 == 0, 0).otherwise(255).cast("bigint")
    zero = F.lit(0).cast("bigint")
    px = e.crossJoin(F.broadcast(n)).select("event_id", (F.col("user_id") % 256).cast("bigint").alias("r"), (i * 7 % 256).alias("g"), (i * 13 % 256).alias("b"), a.alias("a"), "height")  # one row: the number of lines
    rest = n.where("m + 1 < height * 50").select(F.explode(F.sequence(F.col("m") + 1, F.col("height") * 50 - 1)).alias("event_id"), *[zero.alias(c) for c in "rgba"], "height")
    px = px.unionByName(rest).select(zero.alias("image_id"), (i % 50).alias("x"), P.div(i, 50).alias("y"), "r", "g", "b", "a", "height")
    return px.withColumns({"width": F.lit(50).cast("bigint"), "out_width": F.lit(13).cast("bigint"), "out_height": F.greatest(F.lit(1).cast("bigint"), P.div(F.col("height") * 13, 50)), "fit": F.lit("contain")})


@_register("area_sparse_unordered", """WITH h AS (SELECT max(event_id) // 50 + 1 AS h FROM events), g AS (SELECT h, greatest(1, h * 13 // 50) AS oh FROM h),
px AS (SELECT event_id % 50 AS x, event_id // 50 AS y, user_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 13 % 256 AS b, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 255 END AS a FROM events, g
  UNION ALL SELECT e % 50, e // 50, 0, 0, 0, 0 FROM (SELECT unnest(range((SELECT max(event_id) + 1 FROM events), h * 50)) AS e FROM g)),
ax AS (SELECT i, o, least((i + 1) * 13, (o + 1) * 50) - greatest(i * 13, o * 50) AS w FROM (SELECT i, unnest(range(i * 13 // 50, ((i + 1) * 13 + 49) // 50)) AS o FROM range(50) t(i))),
ay AS (SELECT i, o, least((i + 1) * oh, (o + 1) * h) - greatest(i * oh, o * h) AS w FROM (SELECT i, h, oh, unnest(range(i * oh // h, ((i + 1) * oh + h - 1) // h)) AS o FROM (SELECT h, oh, unnest(range(h)) AS i FROM g))),
s AS (SELECT ay.o AS oy, ax.o AS ox, sum(ax.w * ay.w) AS w, sum(a * ax.w * ay.w) AS sa, sum(r * a * ax.w * ay.w) AS sr, sum(g * a * ax.w * ay.w) AS sg, sum(b * a * ax.w * ay.w) AS sb FROM px JOIN ax ON px.x = ax.i JOIN ay ON px.y = ay.i GROUP BY 1, 2)
SELECT 0::BIGINT AS image_id, oy, ox, (CASE WHEN sa = 0 THEN 0 ELSE sr // sa + (2 * (sr % sa) >= sa)::INT END)::BIGINT AS r, (CASE WHEN sa = 0 THEN 0 ELSE sg // sa + (2 * (sg % sa) >= sa)::INT END)::BIGINT AS g,
  (CASE WHEN sa = 0 THEN 0 ELSE sb // sa + (2 * (sb % sa) >= sa)::INT END)::BIGINT AS b, (sa // w + (2 * (sa % w) >= w)::INT)::BIGINT AS a FROM s""")
def area_sparse_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_event_pixels(spark, sf_dir))


@_register("coverage_check", _area_sql(50, 16, 24, "cover", "SELECT image_id, count(*) AS cells, count(*) FILTER (w <> 3200) AS bad FROM s GROUP BY 1").replace("3200", str(_lattice("cover", 64, 50, 16, 24)[0][3] * _lattice("cover", 64, 50, 16, 24)[1][3])))
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = emb_pixels(spark, sf_dir, 50, 16, 24, "cover")
    sums = resample.cell_sums(px)
    images = px.select("image_id", "width", "height", "fit", "out_width", "out_height").distinct()
    bad = resample.bad_coverage(sums, images).groupBy("image_id").agg(F.count("*").alias("bad"))
    cells = sums.groupBy("image_id").agg(F.count("*").alias("cells"))
    return cells.join(bad, "image_id", "left").select("image_id", "cells", F.coalesce("bad", F.lit(0)).alias("bad"))


@_register("axis_overlap", f"""WITH {REQUESTS_SQL}, {_BOXED}, c AS (SELECT request_id AS image_id, width % 97 + 1 AS width, height % 89 + 1 AS height, max_box_width % 40 + 1 AS out_width, max_box_height % 40 + 1 AS out_height, fit FROM boxed),
k AS (SELECT *, fit = 'cover' AND width * out_height > height * out_width AS cx, fit = 'cover' AND width * out_height < height * out_width AS cy FROM c),
x AS (SELECT image_id, 'x' AS axis, unnest(range(width)) AS src, CASE WHEN cx THEN 2 * out_height ELSE out_width END AS s, CASE WHEN cx THEN width * out_height - height * out_width ELSE 0 END AS c0, CASE WHEN cx THEN width * out_height + height * out_width ELSE width * out_width END AS c1, CASE WHEN cx THEN 2 * height ELSE width END AS d FROM k),
y AS (SELECT image_id, 'y' AS axis, unnest(range(height)) AS src, CASE WHEN cy THEN 2 * out_width ELSE out_height END AS s, CASE WHEN cy THEN height * out_width - width * out_height ELSE 0 END AS c0, CASE WHEN cy THEN height * out_width + width * out_height ELSE height * out_height END AS c1, CASE WHEN cy THEN 2 * width ELSE height END AS d FROM k),
a AS (SELECT image_id, axis, src, c0, d, greatest(src * s, c0) AS a, least((src + 1) * s, c1) AS b FROM (SELECT * FROM x UNION ALL SELECT * FROM y)),
o AS (SELECT *, unnest(range((a - c0) // d, (b - c0 + d - 1) // d)) AS o FROM a WHERE a < b)
SELECT axis, image_id, count(*) AS n, sum(w)::BIGINT AS w, sum(w * (src + 1) * (o + 1))::BIGINT AS checksum FROM (SELECT axis, image_id, src, o, least(b, c0 + (o + 1) * d) - greatest(a, c0 + o * d) AS w FROM o) GROUP BY 1, 2""")
def axis_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every request, summed up by image and axis."""
    r = requests(spark, sf_dir)
    images = r.select(F.col("request_id").alias("image_id"), (F.col("width") % 97 + 1).alias("width"), (F.col("height") % 89 + 1).alias("height"), (F.col("max_box_width") % 40 + 1).alias("out_width"), (F.col("max_box_height") % 40 + 1).alias("out_height"), "fit")
    o = resample.axis_overlaps(images)
    return o.groupBy("axis", "image_id").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * (F.col("src") + 1) * (F.col("out") + 1)).alias("checksum"))


# ---- samples and pixels --------------------------------------------------------------------------


@_register("normalize_gray_packed", """WITH t AS (SELECT doc_id, 1 << (doc_id % 3) AS bits, CASE WHEN length(text) > 0 THEN list_transform(string_split(text, ''), lambda c: ord(c) % 256) END AS packed FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT doc_id, bits, unnest(packed) AS byte, unnest(range(len(packed))) AS j FROM t WHERE packed IS NOT NULL),
s AS (SELECT doc_id, bits, j * (8 // bits) + i AS x, (byte >> (8 - bits - i * bits)) & ((1 << bits) - 1) AS v FROM (SELECT *, unnest(range(8 // bits)) AS i FROM b)),
c AS (SELECT doc_id, count(*) AS n, sum((x + 1) * ((v * 255 + ((1 << bits) - 1) // 2) // ((1 << bits) - 1)))::BIGINT AS checksum FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(checksum, 0) AS checksum FROM (SELECT DISTINCT doc_id FROM t) d LEFT JOIN c USING (doc_id)""")
def normalize_gray_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of each text as the bytes of a packed row of 1, 2 or 4 bits; a null or empty text has no samples and sum 0."""
    # Texts are dealt out before they become some five rows a character: a file may hold them all in one piece.
    t = dealt(_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text"))
    bits = F.call_function("shiftleft", F.lit(1), (F.col("doc_id") % 3).cast("int")).cast("bigint")
    chars = t.select("doc_id", bits.alias("bits"), F.posexplode_outer(F.when(F.length("text") > 0, F.split("text", ""))).alias("j", "char"))
    px = normalize.unpack_bytes(chars.select("doc_id", "bits", "j", (F.ascii("char") % 256).alias("byte")), ["doc_id", "bits"], "j", "byte", "bits")
    gray = normalize.gray_pixel(F.col("sample"), F.col("bits"))["r"]
    return px.groupBy("doc_id").agg(F.count("x").alias("n"), F.coalesce(F.sum((F.col("x") + 1) * gray), F.lit(0)).alias("checksum"))


_RAW_SQL = "raw AS (SELECT event_id, event_id * 31 % 65536 AS s0, user_id * 257 % 65536 AS s1, event_id * 7919 % 65536 AS s2, (event_id + user_id) * 13 % 65536 AS s3 FROM events)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id").cast("bigint")
    return _table(spark, sf_dir, "events").select("event_id", (i * 31 % 65536).alias("s0"), (u * 257 % 65536).alias("s1"), (i * 7919 % 65536).alias("s2"), ((i + u) * 13 % 65536).alias("s3"))


def _pixel(row: DataFrame, key: str, channels: dict) -> DataFrame:
    return row.select(key, *[v.alias(k) for k, v in channels.items()])


@_register("normalize_16bit", f"WITH {_RAW_SQL} SELECT event_id, (s0 * 255 + 32767) // 65535 AS r, (s1 * 255 + 32767) // 65535 AS g, (s2 * 255 + 32767) // 65535 AS b, (s3 * 255 + 32767) // 65535 AS a FROM raw")
def normalize_16bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel(_raw(spark, sf_dir), "event_id", normalize.direct_pixel([F.col(f"s{i}") for i in range(4)], 16))


@_register("normalize_gray_alpha", f"WITH {_RAW_SQL} SELECT event_id, s0 % 256 AS r, s0 % 256 AS g, s0 % 256 AS b, s1 % 256 AS a FROM raw")
def normalize_gray_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel(_raw(spark, sf_dir), "event_id", normalize.direct_pixel([F.col("s0") % 256, F.col("s1") % 256], 8))


@_register("trns_gray", f"WITH {_RAW_SQL} SELECT event_id, (s0 * 255 + 32767) // 65535 AS r, (s0 * 255 + 32767) // 65535 AS g, (s0 * 255 + 32767) // 65535 AS b, CASE WHEN s0 = 31 * 17 THEN 0 ELSE 255 END::BIGINT AS a FROM raw")
def trns_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel(_raw(spark, sf_dir), "event_id", normalize.gray_pixel(F.col("s0"), 16, F.lit(31 * 17)))


@_register("trns_rgb", f"WITH {_RAW_SQL} SELECT event_id, s0 % 8 AS r, s1 % 8 AS g, s2 % 8 AS b, CASE WHEN s0 % 8 = 1 AND s1 % 8 = 2 AND s2 % 8 = 3 THEN 0 ELSE 255 END::BIGINT AS a FROM raw")
def trns_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel(_raw(spark, sf_dir), "event_id", normalize.direct_pixel([F.col(f"s{i}") % 8 for i in range(3)], 8, (F.lit(1), F.lit(2), F.lit(3))))


@_register("palette_lookup", f"WITH {_RAW_SQL} SELECT event_id, CASE WHEN s0 % 6 < 5 THEN s0 % 6 * 50 END AS r, CASE WHEN s0 % 6 < 5 THEN 255 - s0 % 6 * 50 END AS g, CASE WHEN s0 % 6 < 5 THEN s0 % 6 * 7 END AS b, CASE WHEN s0 % 6 < 3 THEN s0 % 6 * 64 WHEN s0 % 6 < 5 THEN 255 END AS a FROM raw")
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    palette = F.array(*[F.struct(F.lit(i * 50).alias("r"), F.lit(255 - i * 50).alias("g"), F.lit(i * 7).alias("b")) for i in range(5)])
    return _pixel(_raw(spark, sf_dir), "event_id", normalize.palette_pixel(F.col("s0") % 6, palette, F.array(F.lit(0), F.lit(64), F.lit(128))))


@_register("palette_faults", f"""WITH {REQUESTS_SQL}, c AS (SELECT request_id, 1 << (request_id % 4) AS bit_depth, CASE WHEN width % 17 = 0 THEN NULL ELSE width % 800 END AS plte, CASE WHEN height % 3 = 0 THEN NULL ELSE height % 300 END AS trns FROM req),
k AS (SELECT CASE WHEN plte IS NULL THEN 'MissingPalette' WHEN plte = 0 OR plte % 3 <> 0 THEN 'InvalidPaletteLength' WHEN plte // 3 > 1 << bit_depth THEN 'TooManyPaletteEntries' WHEN coalesce(trns, 0) > plte // 3 THEN 'ExcessTransparency' END AS error_kind FROM c)
SELECT error_kind, count(*) AS n FROM k WHERE error_kind IS NOT NULL GROUP BY 1""")
def palette_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = requests(spark, sf_dir).select(F.col("request_id").alias("image_id"), F.call_function("shiftleft", F.lit(1), (F.col("request_id") % 4).cast("int")).alias("bit_depth"), F.when(F.col("width") % 17 != 0, F.col("width") % 800).alias("plte_bytes"), F.when(F.col("height") % 3 != 0, F.col("height") % 300).alias("trns_bytes"))
    return normalize.bad_palette(c).groupBy("error_kind").agg(F.count("*").alias("n"))


@_register("luma_gray", f"WITH {_RAW_SQL} SELECT event_id, (77 * (s0 % 256) + 150 * (s1 % 256) + 29 * (s2 % 256) + 128) // 256 AS gray FROM raw")
def luma_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("event_id", P.luma(*(F.col(f"s{i}") % 256 for i in range(3))).alias("gray"))


@_register("jpeg_composite", f"WITH {_RAW_SQL} SELECT event_id, (s0 % 256 * (s3 % 256) + 60 * (255 - s3 % 256) + 127) // 255 AS r, (s1 % 256 * (s3 % 256) + 120 * (255 - s3 % 256) + 127) // 255 AS g, (s2 % 256 * (s3 % 256) + 220 * (255 - s3 % 256) + 127) // 255 AS b FROM raw")
def jpeg_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("s3") % 256
    return _raw(spark, sf_dir).select("event_id", *[P.composite(F.col(f"s{i}") % 256, a, bg).alias(n) for i, (n, bg) in enumerate(zip("rgb", (60, 120, 220)))])


@_register("row_bytes", f"WITH {REQUESTS_SQL} SELECT request_id, (width * bit_depth + 7) // 8 AS row_bytes FROM req")
def row_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("request_id", P.row_bytes(F.col("width"), F.col("bit_depth")).alias("row_bytes"))


@_register("gradient_pattern", """WITH h AS (SELECT max(event_id) // 100 AS top FROM events), p AS (SELECT event_id % 100 AS x, event_id // 100 AS y, top FROM events, h),
q AS (SELECT x, y, x * 255 // 99 AS r, CASE WHEN top > 0 THEN y * 255 // top ELSE 0 END AS g FROM p) SELECT x, y, r, g, (r + g) % 256 // 2 AS b, 255 AS a FROM q""")
def gradient_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern 100 wide, and as high as the events fill or begin lines."""
    e = _table(spark, sf_dir, "events")
    n = e.agg((P.div(F.max("event_id"), 100) + 1).alias("height"))
    p = e.crossJoin(F.broadcast(n)).select((F.col("event_id") % 100).alias("x"), P.div(F.col("event_id"), 100).alias("y"), "height")
    return p.select("x", "y", *[c.alias(n) for n, c in zip("rgba", P.gradient(F.col("x"), F.col("y"), 100, F.col("height")))])


# ---- rows, passes, windows -----------------------------------------------------------------------

_PASSES_SQL = "p(pass, x0, y0, dx, dy) AS (VALUES (1, 0, 0, 8, 8), (2, 4, 0, 8, 8), (3, 0, 4, 4, 8), (4, 2, 0, 4, 4), (5, 0, 2, 2, 4), (6, 1, 0, 2, 2), (7, 0, 1, 1, 2))"


@_register("adam7_passes", f"""WITH {REQUESTS_SQL}, {_PASSES_SQL}, s AS (SELECT request_id AS image_id, pass, CASE WHEN width > x0 THEN (width - x0 + dx - 1) // dx ELSE 0 END AS pass_width, CASE WHEN height > y0 THEN (height - y0 + dy - 1) // dy ELSE 0 END AS pass_height FROM req, p)
SELECT image_id, pass::BIGINT AS pass, pass_width, pass_height FROM s WHERE pass_width > 0 AND pass_height > 0""")
def adam7_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.pass_sizes(requests(spark, sf_dir).withColumnRenamed("request_id", "image_id").select("image_id", "width", "height")).select("image_id", "pass", "pass_width", "pass_height")


@_register("adam7_cover", "WITH n AS (SELECT s_suppkey AS image_id, s_suppkey % 9 + 1 AS width, s_suppkey * 7 % 11 + 1 AS height FROM supplier) SELECT image_id, width * height AS samples, width * height AS pixels, 1::BIGINT AS most FROM n")
def adam7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of an interlaced image lies in exactly one pass."""
    n = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("image_id"), (F.col("s_suppkey") % 9 + 1).cast("bigint").alias("width"), (F.col("s_suppkey") * 7 % 11 + 1).cast("bigint").alias("height"))
    per = rows.pass_pixels(n).groupBy("image_id", "y", "x").agg(F.count("*").alias("c"))
    return per.groupBy("image_id").agg(F.sum("c").alias("samples"), F.count("*").alias("pixels"), F.max("c").alias("most"))


@_register("row_contract", """WITH r AS (SELECT user_id AS image_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_id FROM events),
s AS (SELECT image_id, k AS arrival, CASE WHEN event_id % 97 = 0 THEN k + 1 ELSE k END AS y, CASE WHEN event_id % 89 = 0 THEN 36 ELSE 40 END AS n_bytes, 10 AS width, 4 + image_id % 9 AS height FROM r),
t AS (SELECT *, CASE WHEN y <> arrival OR arrival >= height THEN 'UnexpectedRow' WHEN n_bytes <> 4 * width THEN 'InvalidRowLength' END AS kind FROM s),
f AS (SELECT image_id, count(*) AS n, max(height) AS height, min(arrival) FILTER (kind IS NOT NULL) AS first FROM t GROUP BY 1)
SELECT f.image_id, coalesce(t.kind, CASE WHEN n < f.height THEN 'IncompleteImage' END) AS error_kind, (CASE t.kind WHEN 'UnexpectedRow' THEN t.arrival WHEN 'InvalidRowLength' THEN 4 * t.width ELSE f.height END)::BIGINT AS expected, (CASE t.kind WHEN 'UnexpectedRow' THEN t.y WHEN 'InvalidRowLength' THEN t.n_bytes ELSE n END)::BIGINT AS actual
FROM f LEFT JOIN t ON f.image_id = t.image_id AND f.first = t.arrival WHERE t.kind IS NOT NULL OR n < f.height""")
def row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    k = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")
    r = _table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("image_id"), k.alias("arrival"), "event_id")
    r = r.withColumns({"y": F.when(F.col("event_id") % 97 == 0, F.col("arrival") + 1).otherwise(F.col("arrival")), "n_bytes": F.when(F.col("event_id") % 89 == 0, 36).otherwise(40).cast("bigint"), "width": F.lit(10).cast("bigint"), "height": 4 + F.col("image_id") % 9})
    return rows.row_faults(r)


@_register("sample_contract", """WITH i AS (SELECT user_id AS image_id, count(*) AS n, max(event_id % 13) AS mx FROM events GROUP BY 1), k AS (SELECT image_id, n, 12 + image_id % 2 AS width, 1 + image_id % 3 AS height, mx FROM i)
SELECT image_id, CASE WHEN mx >= width THEN 'InvalidPixelCoordinate' ELSE 'IncompleteSamples' END AS error_kind, width * height AS expected, n AS actual FROM k WHERE mx >= width OR n <> width * height""")
def sample_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("image_id"), (F.col("event_id") % 13).alias("x"), F.lit(0).cast("bigint").alias("y"))
    images = e.select("image_id").distinct().withColumns({"width": 12 + F.col("image_id") % 2, "height": 1 + F.col("image_id") % 3})
    return rows.sample_faults(e, images)


_PAGES_SQL = "o AS (SELECT page_id AS image_id, length(html) * 37 AS length FROM pages WHERE html IS NOT NULL)"


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("image_id"), (F.length("html") * 37).cast("bigint").alias("length"))


@_register("chunk_windows", f"WITH {_PAGES_SQL}, c AS (SELECT image_id, length, unnest(range((length + 65535) // 65536)) AS chunk_idx FROM o WHERE length > 0) SELECT image_id, chunk_idx, chunk_idx * 65536 AS start, least(65536, length - chunk_idx * 65536) AS n_bytes FROM c")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.chunk_windows(_outputs(spark, sf_dir))


@_register("chunk_summary", f"WITH {_PAGES_SQL} SELECT image_id, length AS bytes_written, (length + 65535) // 65536 AS chunks, CASE WHEN length % 65536 = 0 THEN 65536 ELSE length % 65536 END AS last_bytes FROM o WHERE length > 0")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.chunk_summary(rows.chunk_windows(_outputs(spark, sf_dir)))


_MCU_SQL = f"WITH {REQUESTS_SQL}, h AS (SELECT request_id AS image_id, height, CASE request_id % 3 WHEN 0 THEN 16 ELSE 8 END AS m FROM req), r AS (SELECT image_id, height, m, unnest(range((height + m - 1) // m)) AS mcu_row FROM h)"


def _mcu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MCU rows of every request."""
    k = F.col("request_id") % 3
    images = requests(spark, sf_dir).select(F.col("request_id").alias("image_id"), "height", F.when(k == 0, "4:2:0").when(k == 1, "4:2:2").otherwise("4:4:4").alias("subsampling"))
    return rows.mcu_rows(images)


@_register("mcu_rows", f"{_MCU_SQL} SELECT image_id, count(*) AS n, sum(n_rows)::BIGINT AS height, sum((mcu_row + 1) * (first_row + n_rows))::BIGINT AS checksum FROM (SELECT image_id, mcu_row, mcu_row * m AS first_row, least(m, height - mcu_row * m) AS n_rows FROM r) GROUP BY 1")
def mcu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MCU rows of every request, summed up by image."""
    r = _mcu(spark, sf_dir)
    return r.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("n_rows").alias("height"), F.sum((F.col("mcu_row") + 1) * (F.col("first_row") + F.col("n_rows"))).alias("checksum"))


@_register("restart_markers", f"{_MCU_SQL} SELECT (mcu_row - 1) % 8 AS restart, count(*) AS n FROM r WHERE mcu_row > 0 GROUP BY 1")
def restart_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mcu(spark, sf_dir).where("restart IS NOT NULL").groupBy("restart").agg(F.count("*").alias("n"))


# ---- whole images: encoded from the rasters, decoded and resampled again ---------------------------


def emb_images(spark: SparkSession, sf_dir: str, height: int, interlaced: bool = False) -> DataFrame:
    """(path, content): the embedding rasters as PNG files, path being the image's number."""
    px = emb_pixels(spark, sf_dir, height, 64, height, "contain").select("image_id", "y", "x", "r", "g", "b", "a")

    def build(key, table):
        import numpy as np
        import pyarrow as pa

        from .codecs import png
        from .sources.images import encode_interlaced

        c = {n: table.column(n).to_numpy() for n in ("y", "x", "r", "g", "b", "a")}
        frame = np.zeros((height, 64, 4), np.uint8)
        frame[c["y"], c["x"]] = np.stack([c["r"], c["g"], c["b"], c["a"]], axis=1)
        data = encode_interlaced(frame) if interlaced else png.encode(frame)
        return pa.table({"path": pa.array([str(key[0].as_py())]), "content": pa.array([data], pa.binary())})

    return px.groupBy("image_id").applyInArrow(build, "path string, content binary")


def _rgba_pixels(done: DataFrame) -> DataFrame:
    """(image_id, oy, ox, r, g, b, a) of raw RGBA thumbnails."""
    from .operators.thumbnail import thumbnail_pixels

    return thumbnail_pixels(done.withColumn("path", F.col("path").cast("bigint")))


def _png_area(fit: str, ow: int, oh: int, interlaced: bool) -> Query:
    from .operators.thumbnail import thumbnails
    from .options import ThumbnailOptions

    options = ThumbnailOptions(max_width=ow, max_height=oh, fit=fit, output="rgba")
    return lambda spark, sf_dir: _rgba_pixels(thumbnails(emb_images(spark, sf_dir, 50, interlaced), options))


# Boxes whose contained size is the box itself.
_register("png_area_contain", _area_sql(50, 32, 25, "contain"))(_png_area("contain", 32, 25, False))
_register("png_area_cover", _area_sql(50, 16, 24, "cover"))(_png_area("cover", 16, 24, False))
_register("png_area_adam7", _area_sql(50, 16, 24, "cover"))(_png_area("cover", 16, 24, True))

_IMAGES_SQL = "i AS (SELECT vec_id // 50 AS image_id FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1)"


@_register("png_header", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR AS path, 64::BIGINT AS width, 50::BIGINT AS height, 'rgba' AS color_type, 8::BIGINT AS bit_depth, TRUE AS interlaced, 4::BIGINT AS source_bpp, 'rgba8' AS auto_color FROM i")
def png_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.images import inspect

    return inspect(emb_images(spark, sf_dir, 50, True), keep_content=False).select("path", "width", "height", "color_type", "bit_depth", "interlaced", "source_bpp", "auto_color")


@_register("png_ihdr", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR AS path, 64::BIGINT AS width, 50::BIGINT AS height, 8::BIGINT AS bit_depth, 'rgba' AS color_type, FALSE AS interlaced FROM i")
def png_ihdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.images import ihdr

    c = ihdr(F.col("content"))
    return emb_images(spark, sf_dir, 50).select("path", *[c[n].alias(n) for n in ("width", "height", "bit_depth", "color_type", "interlaced")])


@_register("png_chunks", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR AS path, t.kind AS type, 1::BIGINT AS n FROM i, (VALUES ('IHDR'), ('IDAT')) t(kind)")
def png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.images import chunks

    return chunks(emb_images(spark, sf_dir, 50)).groupBy("path", "type").agg(F.count("*").alias("n"))


@_register("png_rows", f"WITH {_emb_sql(50)} SELECT image_id, y, count(*) AS n, sum((x + 1) * (r + 3 * g + 5 * b + 7 * a))::BIGINT AS checksum FROM px GROUP BY 1, 2")
def png_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of decoded files, as pixels."""
    from .operators.thumbnail import decode_rows, row_pixels

    px = row_pixels(decode_rows(emb_images(spark, sf_dir, 50)))
    sum_ = F.sum((F.col("x") + 1) * (F.col("r") + 3 * F.col("g") + 5 * F.col("b") + 7 * F.col("a")))
    return px.groupBy(F.col("image_id").cast("bigint").alias("image_id"), "y").agg(F.count("*").alias("n"), sum_.alias("checksum"))


# Events as files of raw samples: 25 wide, 20 high, one sample an event, those without an event 0.
_RAW_FILES_SQL = """n AS (SELECT max(event_id) // 500 + 1 AS n FROM events), g AS (SELECT unnest(range(n * 500)) AS e FROM n),
f AS (SELECT e // 500 AS image_id, e % 500 // 25 AS y, e % 25 AS x, coalesce(v.event_id, 0) AS v FROM g LEFT JOIN (SELECT DISTINCT event_id FROM events) v ON v.event_id = g.e)"""


def _raw_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content): gray files of 16 bits whose sample 155 is transparent, or files of 4 bits with a palette of 16 colours, the first five of them not opaque."""
    e = _table(spark, sf_dir, "events").where("event_id IS NOT NULL").select("event_id").distinct()

    def build(key, table):
        import struct

        import numpy as np
        import pyarrow as pa

        from .sources.images import encode_raw

        i = table.column("event_id").to_numpy()
        v = np.zeros(500, np.int64)
        v[i % 500] = i
        if kind == "gray16":
            data = encode_raw((v * 31 % 65536).reshape(20, 25, 1), 16, 0, trns=struct.pack(">H", 155))
        else:
            colors = np.arange(16)
            palette = np.stack([colors * 16, 255 - colors * 16, colors * 5], axis=1).astype(np.uint8).tobytes()
            data = encode_raw((v * 7 % 16).reshape(20, 25, 1), 4, 3, palette, bytes(range(0, 250, 50)))
        return pa.table({"path": pa.array([str(key[0].as_py())]), "content": pa.array([data], pa.binary())})

    return e.withColumn("image_id", P.div(F.col("event_id"), 500)).groupBy("image_id").applyInArrow(build, "path string, content binary")


def _raw_file_pixels(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators.thumbnail import decode_rows, row_pixels

        return row_pixels(decode_rows(_raw_files(spark, sf_dir, kind))).withColumn("image_id", F.col("image_id").cast("bigint"))

    return query


_register("png_gray16", f"WITH {_RAW_FILES_SQL}, s AS (SELECT image_id, y, x, v * 31 % 65536 AS s FROM f), q AS (SELECT *, (s * 255 + 32767) // 65535 AS q FROM s) SELECT image_id, y, x, q AS r, q AS g, q AS b, CASE WHEN s = 155 THEN 0 ELSE 255 END AS a FROM q")(_raw_file_pixels("gray16"))
_register("png_palette", f"WITH {_RAW_FILES_SQL}, s AS (SELECT image_id, y, x, v * 7 % 16 AS s FROM f) SELECT image_id, y, x, s * 16 AS r, 255 - s * 16 AS g, s * 5 AS b, CASE WHEN s < 5 THEN s * 50 ELSE 255 END AS a FROM s")(_raw_file_pixels("palette"))


@_register("png_headers_of_files", f"WITH {_RAW_FILES_SQL}, i AS (SELECT DISTINCT image_id FROM f) SELECT image_id::VARCHAR AS path, kind, 25::BIGINT AS width, 20::BIGINT AS height, CASE kind WHEN 'gray16' THEN 'grayscale' ELSE 'indexed' END AS color_type, CASE kind WHEN 'gray16' THEN 16::BIGINT ELSE 4::BIGINT END AS bit_depth, CASE kind WHEN 'gray16' THEN 2::BIGINT ELSE 5::BIGINT END AS raw_trns_length, CASE kind WHEN 'gray16' THEN 2::BIGINT ELSE 1::BIGINT END AS source_bpp, CASE kind WHEN 'gray16' THEN 'grayscale-alpha8' ELSE 'rgba8' END AS auto_color FROM i, (VALUES ('gray16'), ('palette')) t(kind)")
def png_headers_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.images import inspect

    both = [inspect(_raw_files(spark, sf_dir, kind), keep_content=False).withColumn("kind", F.lit(kind)) for kind in ("gray16", "palette")]
    return both[0].unionByName(both[1]).select("path", "kind", "width", "height", "color_type", "bit_depth", "raw_trns_length", "source_bpp", "auto_color")


@_register("png_roundtrip", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR AS path, 64::BIGINT AS out_width, 50::BIGINT AS out_height, 'image/png' AS mime_type, TRUE AS same FROM i")
def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG thumbnails of full size decode to the pixels that raw RGBA gives."""
    from .operators.thumbnail import thumbnails
    from .options import PngOptions, ThumbnailOptions

    images = emb_images(spark, sf_dir, 50)
    made = thumbnails(images, ThumbnailOptions(png=PngOptions(filter="paeth", compression="high")))
    again = thumbnails(made.select("path", F.col("bytes").alias("content")), ThumbnailOptions(output="rgba"))
    raw = thumbnails(images, ThumbnailOptions(output="rgba")).select("path", F.col("bytes").alias("raw"))
    return made.select("path", "out_width", "out_height", "mime_type").join(again.select("path", "bytes"), "path").join(raw, "path").select("path", "out_width", "out_height", "mime_type", (F.col("bytes") == F.col("raw")).alias("same"))


@_register("jpeg_encode", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR AS path, 'image/jpeg' AS mime_type, 'FFD8' AS head, 'FFD9' AS tail FROM i")
def jpeg_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.thumbnail import thumbnails
    from .options import ThumbnailOptions

    done = thumbnails(emb_images(spark, sf_dir, 50), ThumbnailOptions(output="jpeg"))
    return done.select("path", "mime_type", F.hex(F.substring("bytes", 1, 2)).alias("head"), F.hex(F.substring("bytes", -2, 2)).alias("tail"))


@_register("rejected_images", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR AS path, CASE image_id % 4 WHEN 0 THEN 'DecodeFailure' WHEN 1 THEN 'TruncatedInput' WHEN 2 THEN 'LimitExceeded.InputWidth' ELSE 'LimitExceeded.InputBytes' END AS error_kind FROM i")
def rejected_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files and limits give typed rows, never a failed job."""
    from .operators.thumbnail import thumbnails
    from .options import Limits, ThumbnailOptions

    k = F.col("path").cast("bigint") % 4
    images = emb_images(spark, sf_dir, 50)
    big = F.concat("content", F.repeat(F.lit("x"), 400_000).cast("binary"))
    half = F.substring("content", 1, 40)  # within the first IDAT
    bad = images.withColumn("content", F.when(k == 0, F.lit(b"no image at all")).when(k == 1, half).when(k == 2, F.col("content")).otherwise(big))
    done = thumbnails(bad, ThumbnailOptions(limits=Limits(max_width=63, max_input_bytes=300_000)))
    return done.select("path", "error_kind")


@_register("encoded_chunks", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR AS image_id, 12800::BIGINT AS bytes_written, 13::BIGINT AS chunks FROM i")
def encoded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.thumbnail import thumbnails
    from .options import ThumbnailOptions

    done = thumbnails(emb_images(spark, sf_dir, 50), ThumbnailOptions(output="rgba")).select(F.col("path").alias("image_id"), "bytes")
    return rows.chunks(done, 1024).groupBy("image_id").agg(F.sum(F.length("bytes")).alias("bytes_written"), F.count("*").alias("chunks"))


@_register("stream_rows", _area_sql(50, 32, 25, "contain"))
def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanlines through the stateful row stream, over two micro-batches."""
    from .operators.thumbnail import decode_rows, row_pixels
    from .streaming.rows import OUTPUT, resample_rows

    rows_ = decode_rows(emb_images(spark, sf_dir, 50)).select(F.col("path").alias("image_id"), "y", "rgba", *[F.lit(v).alias(n) for n, v in (("width", 64), ("height", 50), ("fit", "contain"), ("out_width", 32), ("out_height", 25))])
    folder = _folder(spark, "rows")
    no_data = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        # The stream runs once after each half, over however many files its tasks wrote; the second run goes on from the state of the first.
        for half in ("y < 23", "y >= 23"):
            rows_.where(half).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(rows_.schema).parquet(folder)
            q = resample_rows(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").option("path", f"{folder}-out").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", no_data)
    done = spark.read.schema(OUTPUT).parquet(f"{folder}-out").where("error_kind IS NULL").select(F.struct("image_id", "oy").alias("k"), F.lit(0).alias("y"), "rgba")
    px = row_pixels(done, "k")
    return px.select(F.col("image_id.image_id").cast("bigint").alias("image_id"), F.col("image_id.oy").alias("oy"), F.col("x").alias("ox"), *"rgba")


@_register("staged_sink", f"WITH {_IMAGES_SQL} SELECT image_id::VARCHAR || '.png' AS name, 32::BIGINT AS width, 25::BIGINT AS height, 'rgba' AS color_type, 8::BIGINT AS bit_depth, FALSE AS interlaced, NULL::VARCHAR AS header_error FROM i")
def staged_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails as files: encoded aside within the write, renamed at commit, and their headers read by ranges."""
    from .operators.thumbnail import write
    from .options import ThumbnailOptions
    from .sources.ranges import headers, files

    folder = _folder(spark, "staged")
    write(emb_images(spark, sf_dir, 50), F.concat("path", F.lit(".png")), ThumbnailOptions(max_width=32), folder)
    found = headers(files(spark, folder))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "height", "color_type", "bit_depth", "interlaced", "header_error")
