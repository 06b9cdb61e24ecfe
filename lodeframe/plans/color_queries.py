"""Colours made of customer keys."""

from pyspark.sql import functions as F

from lodeframe.functions import color as K
from lodeframe.plans.registry import query, table

#: The colour of a customer in SQL: three bytes of the key times a constant.
_RGB = "SELECT c_custkey, r, g, b, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo FROM (SELECT c_custkey, ((v >> 16) & 255)::DOUBLE AS r, ((v >> 8) & 255)::DOUBLE AS g, (v & 255)::DOUBLE AS b FROM (SELECT c_custkey, c_custkey * 40503 AS v FROM customer))"
_HUE = "CASE WHEN hi = lo THEN 0 WHEN hi = x THEN 60 * ((y - z) / (hi - lo) + CASE WHEN y < z THEN 6 ELSE 0 END) WHEN hi = y THEN 60 * ((z - x) / (hi - lo) + 2) ELSE 60 * ((x - y) / (hi - lo) + 4) END"
_LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"


def _colors(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", K.from_packed(F.col("c_custkey") * 40503).alias("c"))


@query("k01_k03_hex", f"WITH c AS ({_RGB}) SELECT c_custkey, printf('#%02x%02x%02x', r::INTEGER, g::INTEGER, b::INTEGER) AS text, r AS red, b AS blue FROM c")
def hex_texts(spark, sf_dir):
    rows = _colors(spark, sf_dir).select("c_custkey", K.format_hex(F.col("c")).alias("text")).withColumn("p", K.parse_hex("text"))
    return rows.select("c_custkey", "text", F.col("p.r").alias("red"), F.col("p.b").alias("blue"))


@query("k02_packed", f"WITH c AS ({_RGB}) SELECT c_custkey, round({_HUE}, 2) AS h, 'HV' AS space FROM c")
def packed(spark, sf_dir):
    hsv = K.rgb_to_hsv(F.col("c"))
    rows = _colors(spark, sf_dir).select("c_custkey", K.format_packed("HV", hsv["h"], hsv["s"], hsv["v"]).alias("text"), hsv["h"].alias("own")).withColumn("p", K.parse_packed("text"))
    # Beyond 327.67 hundredths wrap around; the turn is added back.
    h = F.pmod(F.col("p.channels")[0], F.lit(655.36))
    return rows.select("c_custkey", F.round(h, 2).alias("h"), F.col("p.space").alias("space"))


@query("k04_k05_k08_spaces", f"WITH c AS ({_RGB}) SELECT c_custkey, round({_HUE}, 6) AS hue, round(CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END, 6) AS hsl_s, round((hi + lo) / 2, 6) AS hsl_l, round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END, 6) AS hsv_s, round(1 - hi, 6) AS key, round(0.299 * x + 0.587 * y + 0.114 * z, 6) AS luma, round(lo, 6) AS white FROM c")
def spaces(spark, sf_dir):
    c = F.col("c")
    hsl, hsv = K.rgb_to_hsl(c), K.rgb_to_hsv(c)
    return _colors(spark, sf_dir).select("c_custkey", F.round(hsl["h"], 6).alias("hue"), F.round(hsl["s"], 6).alias("hsl_s"), F.round(hsl["l"], 6).alias("hsl_l"), F.round(hsv["s"], 6).alias("hsv_s"), F.round(K.rgb_to_cmyk(c)["k"], 6).alias("key"), F.round(K.rgb_to_yuv(c)["y"], 6).alias("luma"), F.round(K.rgb_to_hwb(c)["w"], 6).alias("white"))


@query("k04_k08_round_trips", f"WITH c AS ({_RGB}) SELECT c_custkey, {', '.join(f'{x} AS {n}_{x}' for n in ('hsl', 'hsv', 'cmyk', 'yuv', 'hwb') for x in 'rgb')} FROM c")
def round_trips(spark, sf_dir):
    c = F.col("c")
    there = {"hsl": K.rgb_to_hsl(c), "hsv": K.rgb_to_hsv(c), "cmyk": K.rgb_to_cmyk(c), "yuv": K.rgb_to_yuv(c), "hwb": K.rgb_to_hwb(c)}
    rows = _colors(spark, sf_dir).select("c_custkey", *(v.alias(n) for n, v in there.items()))
    rows = rows.withColumn("turned", K.hwb_to_hsv(F.col("hwb")))
    back = {"hsl": K.hsl_to_rgb(F.col("hsl")), "hsv": K.hsv_to_rgb(F.col("hsv")), "cmyk": K.cmyk_to_rgb(F.col("cmyk")), "yuv": K.yuv_to_rgb(F.col("yuv")), "hwb": K.hsv_to_rgb(F.col("turned"))}
    return rows.select("c_custkey", *((F.round(v[x], 3) + 0.0).alias(f"{n}_{x}") for n, v in back.items() for x in "rgb"))


@query("k06_k07_k09_k12_light", f"WITH c AS ({_RGB}), l AS (SELECT *, {_LIN.format('x')} AS p, {_LIN.format('y')} AS q, {_LIN.format('z')} AS s FROM c) SELECT c_custkey, round(0.2126 * p + 0.7152 * q + 0.0722 * s, 6) AS luminance, round(1.05 / (0.2126 * p + 0.7152 * q + 0.0722 * s + 0.05), 6) AS on_white, round(0.4124564 * p + 0.3575761 * q + 0.1804375 * s, 6) AS xyz_x, round(0.2104542553 * cbrt(0.4122214708 * p + 0.5363325363 * q + 0.0514459929 * s) + 0.7936177850 * cbrt(0.2119034982 * p + 0.6806995451 * q + 0.1073969566 * s) - 0.0040720468 * cbrt(0.0883024619 * p + 0.2817188376 * q + 0.6299787005 * s), 6) + 0.0 AS ok_l FROM l")
def light(spark, sf_dir):
    c = F.col("c")
    return _colors(spark, sf_dir).select("c_custkey", F.round(K.luminance(c), 6).alias("luminance"), F.round(K.contrast(c, K.rgb(255, 255, 255)), 6).alias("on_white"), F.round(K.rgb_to_xyz(c)["x"], 6).alias("xyz_x"), (F.round(K.rgb_to_oklab(c)["l"], 6) + 0.0).alias("ok_l"))


@query("k10_k11_mixes", f"WITH c AS ({_RGB}) SELECT c_custkey, round(r + (255 - r) * 0.25, 6) AS mixed, round(sqrt(r * r + g * g + b * b), 4) AS far FROM c")
def mixes(spark, sf_dir):
    c, white = F.col("c"), K.rgb(255, 255, 255)
    lab = lambda v: K.color("lab", v["r"], v["g"], v["b"])
    return _colors(spark, sf_dir).select("c_custkey", F.round(K.mix(c, white, 0.25)["r"], 6).alias("mixed"), F.round(K.difference(lab(c), lab(K.rgb(0, 0, 0))), 4).alias("far"))


@query("k13_blends", f"WITH c AS ({_RGB}) SELECT c_custkey, round(x * z, 6) AS multiplied, round(x + z - x * z, 6) AS screened, round(abs(x - z), 6) AS differed, round(255 * (x * 0.5 + z * 0.5), 4) AS half_over FROM c")
def blends(spark, sf_dir):
    c = F.col("c")
    s, d = c["r"] / 255, c["b"] / 255
    turned = K.rgb(c["b"], c["g"], c["r"])
    return _colors(spark, sf_dir).select("c_custkey", *(F.round(K.BLENDS[m](s, d), 6).alias(n) for m, n in (("multiply", "multiplied"), ("screen", "screened"), ("difference", "differed"))), F.round(K.over(c, 0.5, turned, 1.0)["r"], 4).alias("half_over"))


@query("k14_adjusted", f"WITH c AS ({_RGB}) SELECT c_custkey, 255 - r AS inverted, least(255, g * 1.5) AS bright, round((hi + lo) / 2 * 255, 4) AS grey FROM c")
def adjusted(spark, sf_dir):
    c = F.col("c")
    return _colors(spark, sf_dir).select("c_custkey", K.inverted(c)["r"].alias("inverted"), K.brightened(c, 1.5)["g"].alias("bright"), F.round(K.saturated(c, 0.0)["g"], 4).alias("grey"))


_TAGS = ("HS", "HV", "CK", "YU", "XZ", "LB", "LC", "OB", "OC", "HW")


@query("k02_packed_spaces", f"WITH c AS ({_RGB}) SELECT c_custkey, {', '.join(f'round(r / 10 - g / 10, 2) AS {t.lower()}' for t in _TAGS)} FROM c")
def packed_spaces(spark, sf_dir):
    """The first two channels of each space's text, the second one below zero."""
    r, g, b = (F.col("c")[x] / 10 for x in "rgb")
    texts = _colors(spark, sf_dir).select("c_custkey", *(K.format_packed(t, r, -g, b, *([b] if t == "CK" else [])).alias(t.lower()) for t in _TAGS))
    rows = texts.select("c_custkey", *(K.parse_packed(t.lower())["channels"].alias(t.lower()) for t in _TAGS))
    return rows.select("c_custkey", *((F.round(F.col(t.lower())[0] + F.col(t.lower())[1], 2) + 0.0).alias(t.lower()) for t in _TAGS))


#: The published blend formulas over x and z, fractions of source and backdrop.
_BLENDS = {
    "normal": "x",
    "overlay": "CASE WHEN z <= 0.5 THEN 2 * x * z ELSE 1 - 2 * (1 - x) * (1 - z) END",
    "darken": "least(x, z)",
    "lighten": "greatest(x, z)",
    "color_dodge": "CASE WHEN z = 0 THEN 0 WHEN x >= 1 THEN 1 ELSE least(1, z / (1 - x)) END",
    "color_burn": "CASE WHEN z >= 1 THEN 1 WHEN x <= 0 THEN 0 ELSE 1 - least(1, (1 - z) / x) END",
    "hard_light": "CASE WHEN x <= 0.5 THEN 2 * x * z ELSE 1 - 2 * (1 - x) * (1 - z) END",
    "soft_light": "CASE WHEN x <= 0.5 THEN z - (1 - 2 * x) * z * (1 - z) ELSE z + (2 * x - 1) * (CASE WHEN z <= 0.25 THEN ((16 * z - 12) * z + 4) * z ELSE sqrt(z) END - z) END",
    "exclusion": "x + z - 2 * x * z",
}


@query("k13_all_blends", f"WITH c AS ({_RGB}) SELECT c_custkey, {', '.join(f'round({sql}, 6) + 0.0 AS {name}' for name, sql in _BLENDS.items())} FROM c")
def all_blends(spark, sf_dir):
    s, d = F.col("c")["r"] / 255, F.col("c")["b"] / 255
    return _colors(spark, sf_dir).select("c_custkey", *((F.round(K.BLENDS[name](s, d), 6) + 0.0).alias(name) for name in _BLENDS))


@query(
    "k14_kelvin",
    """WITH t AS (SELECT c_custkey, least(greatest(c_custkey * 37 % 45000, 1000), 40000) / 100.0::DOUBLE AS t FROM customer)
SELECT c_custkey, round(CASE WHEN t <= 66 THEN 255 ELSE least(255, greatest(0, 329.698727446 * pow(t - 60, -0.1332047592))) END, 4) AS red,
 round(CASE WHEN t <= 66 THEN least(255, greatest(0, 99.4708025861 * ln(t) - 161.1195681661)) ELSE least(255, greatest(0, 288.1221695283 * pow(t - 60, -0.0755148492))) END, 4) AS green,
 round(CASE WHEN t >= 66 THEN 255 WHEN t <= 19 THEN 0 ELSE least(255, greatest(0, 138.5177312231 * ln(t - 10) - 305.0447927307)) END, 4) AS blue FROM t""",
)
def kelvin(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", K.kelvin_to_rgb(F.col("c_custkey") * 37 % 45000).alias("c"))
    return rows.select("c_custkey", *(F.round(F.col("c")[x], 4).alias(n) for x, n in (("r", "red"), ("g", "green"), ("b", "blue"))))
