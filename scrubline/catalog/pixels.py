"""Image queries over pixel tables made from the embeddings: 8 x 8, three channels."""

from pyspark.sql import functions as F

from scrubline.catalog.registry import query, table
from scrubline.operators import pixels as P

TILE = 4  # smaller than the images, so measures cross tile edges

PIX = """(select vec_id as image_id, p // 8 as y, p % 8 as x, ch::int as channel,
   floor((embedding[(p + 21 * ch) % 64 + 1]::double + 0.6) / 1.2 * 256)::int as v
 from embeddings, unnest(range(64)) as a(p), unnest(range(3)) as b(ch))"""
TWIN = f"(select image_id, y, x, channel, least(255, greatest(0, v + ((x * 7 + y * 3 + channel) % 5 - 2) * 6)) as v from {PIX})"


def pixels(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel")
    )
    p = e.select("image_id", "channel", F.col("embedding"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    value = F.get("embedding", ((F.col("p") + 21 * F.col("channel")) % 64).cast("int")).cast("double")
    return p.select(
        "image_id", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).cast("long").alias("x"), "channel",
        F.floor((value + 0.6) / 1.2 * 256).cast("int").alias("v"),
    )


def twin(df):
    shift = ((F.col("x") * 7 + F.col("y") * 3 + F.col("channel")) % 5 - 2) * 6
    return df.withColumn("v", F.least(F.lit(255), F.greatest(F.lit(0), F.col("v") + shift)).cast("int"))


HIST = f"""select i.image_id, i.channel, g.g::int as intensity, coalesce(h.n, 0) as "count"
 from (select distinct image_id, channel from {PIX}) i cross join unnest(range(256)) as g(g)
 left join (select image_id, channel, v, count(*) as n from {PIX} group by all) h
   on h.image_id = i.image_id and h.channel = i.channel and h.v = g.g"""


@query("pixel_histogram", HIST)
def pixel_histogram(spark, sf):
    return P.pixel_histogram(pixels(spark, sf))


@query(
    "pixel_histogram_norm",
    f"""with h as ({HIST}) select image_id, channel, intensity,
    round("count" / sqrt(sum("count" * "count") over (partition by image_id, channel)), 6) as "count" from h""",
)
def pixel_histogram_norm(spark, sf):
    return P.pixel_histogram_norm(pixels(spark, sf)).withColumn("count", F.round("count", 6))


GRAY = f"""(select image_id, y, x, round(0.299::double * max(v) filter (channel = 0) + 0.587::double * max(v) filter (channel = 1)
  + 0.114::double * max(v) filter (channel = 2)) as g from {PIX} group by image_id, y, x)"""
BLUR = f"""with n as (select image_id, y, x, g,
   lag(g) over r as l, lead(g) over r as ri, lag(g) over c as u, lead(g) over c as d from {GRAY}
   window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y))
 select image_id, var_pop(coalesce(l, ri) + coalesce(ri, l) + coalesce(u, d) + coalesce(d, u) - 4 * g) as score
 from n group by image_id"""


# Scores are whole multiples of 1/4096; the offset keeps exact ties from splitting on the last bit.
@query("blur_score", f"select image_id, round(score + 1e-7, 5) as score, score < 100 as blurry from ({BLUR})")
def blur_score(spark, sf):
    return P.blur_score(pixels(spark, sf), TILE).withColumn("score", F.round(F.col("score") + 1e-7, 5))


MSE = f"""select o.image_id, avg((o.v - p.v) * (o.v - p.v)) as mse from {PIX} o join {TWIN} p
 on o.image_id = p.image_id and o.y = p.y and o.x = p.x and o.channel = p.channel group by o.image_id"""
PSNR = "case when mse > 0 then 10 * log10(65025.0::double / mse) end"


@query("mse_psnr", f"select image_id, round(mse, 4) as mse, round({PSNR}, 4) as psnr, true as same_size from ({MSE})")
def mse_psnr(spark, sf):
    p = pixels(spark, sf)
    return P.mse_psnr(p, twin(p)).withColumns({c: F.round(c, 4) for c in ("mse", "psnr")})


# Of every three images one lacks its last row on one side, one has no twin.
@query(
    "mse_psnr_unequal",
    f"""select image_id, case when image_id % 3 = 0 then round(mse, 4) end as mse, case when image_id % 3 = 0 then round({PSNR}, 4) end as psnr,
    image_id % 3 = 0 as same_size from ({MSE})""",
)
def mse_psnr_unequal(spark, sf):
    p = pixels(spark, sf)
    i = F.col("image_id") % 3
    other = twin(p).where((i == 0) | ((i == 1) & (F.col("y") < 7)))
    return P.mse_psnr(p, other).withColumns({c: F.round(c, 4) for c in ("mse", "psnr")})


# Direct form: every 7 x 7 window joined to its pixels.
SSIM = f"""with ab as materialized (select o.image_id, o.channel, o.y, o.x, o.v::double as a, p.v::double as b
   from {PIX} o join {TWIN} p using (image_id, y, x, channel)),
 w as (select c.image_id, c.channel, c.y, c.x, count(*) as k, avg(n.a) as ma, avg(n.b) as mb,
   var_samp(n.a) as va, var_samp(n.b) as vb, covar_samp(n.a, n.b) as cov
   from ab c join ab n on n.image_id = c.image_id and n.channel = c.channel
    and n.y between c.y - 3 and c.y + 3 and n.x between c.x - 3 and c.x + 3
   where c.y between 3 and 4 and c.x between 3 and 4 group by all),
 s as (select image_id, channel, avg(((2 * ma * mb + 6.5025::double) * (2 * cov + 58.5225::double))
   / ((ma * ma + mb * mb + 6.5025::double) * (va + vb + 58.5225::double))) as s from w where k = 49 group by all)
 select image_id, avg(s) as ssim from s group by image_id"""


@query("ssim", f"select image_id, round(ssim, 4) as ssim from ({SSIM})")
def ssim(spark, sf):
    p = pixels(spark, sf)
    return P.ssim(p, twin(p), TILE).withColumn("ssim", F.round("ssim", 4))


@query(
    "quality_summary",
    f"""with m as (select ({PSNR.replace('mse', 'm.mse')}) as psnr, m.mse, s.ssim from ({MSE}) m join ({SSIM}) s using (image_id)),
    a as (select avg(ssim) as s, avg(psnr) as p, avg(mse) as m from m)
    select round(s, 4) as avg_ssim, round(p, 4) as avg_psnr, round(m, 4) as avg_mse,
     case when s > 0.9 then 'Excellent' when s > 0.8 then 'Good' else 'Fair' end as ssim_label,
     case when p > 30 then 'High Quality' when p > 25 then 'Good' else 'Fair' end as psnr_label,
     case when m < 100 then 'Low Error' else 'Moderate' end as mse_label,
     case when s > 0.9 and p > 30 then 'Excellent' when s > 0.8 then 'Good' else 'Fair' end as overall_label from a""",
)
def quality_summary(spark, sf):
    p = pixels(spark, sf)
    s = P.quality_summary(P.quality_metrics(p, twin(p), TILE))
    return s.withColumns({c: F.round(c, 4) for c in ("avg_ssim", "avg_psnr", "avg_mse")})


@query(
    "repair_plan",
    f"""with b as (select image_id, 200 + image_id % 50 * 20 as width, score < 12000 as blurry from ({BLUR}))
    select image_id, width, blurry, case when blurry and width < 500 then 1.5::double else 1.0 end as upscale,
     case when blurry then 0.5::double else 0.2 end as sharpen,
     case when blurry and width < 500 then 'Auto-Upscaled (Small image)|Sharpened (Gentle)' when blurry then 'Sharpened (Gentle)'
      else 'Clarified (Subtle)' end as actions from b""",
)
def repair_plan(spark, sf):
    """The random pixels score far above the blur limit, so the query moves it to split them."""
    scores = P.blur_score(pixels(spark, sf), TILE)
    images = scores.select(
        "image_id", (200 + F.col("image_id") % 50 * 20).alias("width"), (F.col("score") < 12000).alias("blurry")
    )
    return P.repair_plan(images).withColumn("actions", F.array_join("actions", "|"))


@query(
    "pixel_normalize",
    f"""select image_id, y, x, channel, round((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0), 6) as minmax,
     round((v - avg(v) over w) / nullif(stddev_pop(v) over w, 0), 6) as zscore from {PIX}
    window w as (partition by image_id, channel)""",
)
def pixel_normalize(spark, sf):
    p = pixels(spark, sf)
    both = P.pixel_normalize(P.pixel_normalize(p).withColumnRenamed("norm", "minmax"), "zscore")
    return both.select(
        "image_id", "y", "x", "channel", F.round("minmax", 6).alias("minmax"), F.round("norm", 6).alias("zscore")
    )


@query(
    "fit_size",
    """with s as (select p_partkey as id, 320 + p_size * 40 as width, 240 + (p_partkey % 50) * 40 as height from part),
    c as (select *, width::double / height as r, greatest(floor(1024::double * height / width), 1) as h0, greatest(ceil(1024::double * height / width), 1) as h1,
      greatest(floor(1024::double * width / height), 1) as w0, greatest(ceil(1024::double * width / height), 1) as w1 from s)
    select id, width, height,
     case when width <= 1024 and height <= 1024 then width when width >= height then 1024
      else case when abs(r - w1 / 1024) < abs(r - w0 / 1024) then w1 else w0 end end::bigint as fit_width,
     case when width <= 1024 and height <= 1024 then height when width < height then 1024
      else case when abs(r - 1024 / h1) < abs(r - 1024 / h0) then h1 else h0 end end::bigint as fit_height,
     floor(width * 1.5)::bigint as up_width, floor(height * 1.5)::bigint as up_height from c""",
)
def fit_size(spark, sf):
    sizes = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (320 + F.col("p_size") * 40).alias("width"),
        (240 + F.col("p_partkey") % 50 * 40).alias("height"),
    )
    return P.upscale_size(P.fit_size(sizes))
