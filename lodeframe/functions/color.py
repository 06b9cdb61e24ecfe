"""Colours as column expressions: structs of DOUBLE channels, in the units usual for each space.

rgb 0 to 255; hsl, hsv and hwb degrees and fractions; cmyk fractions; yuv BT.601 with y 0 to 1; xyz with white Y = 1 (D65); lab, lch, oklab and oklch as
published. Alpha is a fraction beside the channels. Rounding to bytes takes halves away from zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("double")


def color(names: str, *channels) -> Column:
    return F.struct(*(_c(v).alias(n) for n, v in zip(names, channels, strict=True)))


def rgb(r, g, b) -> Column:
    return color("rgb", r, g, b)


def from_packed(v) -> Column:
    """0xRRGGBB."""
    v = (F.col(v) if isinstance(v, str) else v).cast("long")
    part = lambda s: F.shiftrightunsigned(v, s).bitwiseAND(F.lit(255).cast("long"))
    return rgb(part(16), part(8), part(0))


def parse_hex(text) -> Column:
    """``#RGB``, ``#RGBA``, ``#RRGGBB``, ``#RRGGBBAA`` and the same behind ``0x``, as ``(r, g, b, a)``; NULL for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    digits = F.regexp_extract(text, r"^(?:#|0[xX])([0-9A-Fa-f]{8}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3,4})$", 1)
    full = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    part = lambda i: F.conv(F.substring(full, 1 + 2 * i, 2), 16, 10).cast("double")
    alpha = F.when(F.length(full) == 8, part(3) / 255).otherwise(1.0)
    return F.when(F.length(digits) > 0, F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), alpha.alias("a")))


def _byte(v: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")


def format_hex(c: Column, alpha=None) -> Column:
    """``#rrggbb``, or ``#rrggbbaa`` with an alpha."""
    parts = [_byte(c["r"]), _byte(c["g"]), _byte(c["b"])] + ([_byte(_c(alpha) * 255)] if alpha is not None else [])
    return F.format_string("#" + "%02x" * len(parts), *parts)


#: Two-letter tags of packed texts of the other spaces. Fixed values.
PACKED = {"HS": "hsl", "HV": "hsv", "CK": "cmyk", "YU": "yuv", "XZ": "xyz", "LB": "lab", "LC": "lch", "OB": "lab", "OC": "lch", "HW": "hwb"}


def parse_packed(text) -> Column:
    """``(space, channels)`` of a tag with channels of four hexadecimal digits, hundredths in two's complement.

    The pattern is matched once, and all digits are one number. Lambdas would match it anew for each channel, outside of generated code;
    a text that is worked out should be a column of its own."""
    text = F.col(text) if isinstance(text, str) else text
    tag_at = F.when(F.startswith(text, F.lit("#")), 2).otherwise(1)
    digits = F.substring(text, tag_at + 2, F.lit(16))
    bits = F.conv(digits, 16, -10).cast("long")
    channel = lambda i: F.shiftright(F.shiftleft(bits, 16 * i), 48) / 100
    three = [channel(i) for i in (1, 2, 3)]
    channels = F.when(F.length(digits) == 16, F.array(channel(0), *three)).otherwise(F.array(*three))
    return F.when(text.rlike("^#?(?:HS|HV|CK|YU|XZ|LB|LC|OB|OC|HW)(?:[0-9A-Fa-f]{4}){3,4}$"), F.struct(F.substring(text, tag_at, F.lit(2)).alias("space"), channels.alias("channels")))


def format_packed(tag: str, *channels) -> Column:
    if tag not in PACKED:
        raise ValueError(f"no space is tagged {tag}")
    # With a digit in front, so that zeros stay.
    parts = [F.substring(F.hex(F.round(_c(v) * 100).cast("int").bitwiseAND(F.lit(65535)) + 65536), 2, 4) for v in channels]
    return F.concat(F.lit("#" + tag), F.lower(F.concat(*parts)))


def _extremes(c: Column) -> tuple[Column, ...]:
    r, g, b = (c[x] / 255 for x in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return r, g, b, high, low, high - low


def hue(c: Column) -> Column:
    """Degrees; 0 for greys."""
    r, g, b, high, _, d = _extremes(c)
    sixth = F.when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d == 0, 0.0).otherwise(sixth * 60)


def rgb_to_hsl(c: Column) -> Column:
    _, _, _, high, low, d = _extremes(c)
    light = (high + low) / 2
    return color("hsl", hue(c), F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))), light)


def rgb_to_hsv(c: Column) -> Column:
    _, _, _, high, _, d = _extremes(c)
    return color("hsv", hue(c), F.when(high == 0, 0.0).otherwise(d / high), high)


def _from_hue(h: Column, chroma: Column, base: Column) -> Column:
    h6 = F.pmod(h, F.lit(360.0)) / 60

    def channel(turn: int) -> Column:
        k = F.pmod(h6 + turn, F.lit(6.0))
        return (base + chroma * (1 - F.greatest(F.lit(0.0), F.least(k - 1, 5 - k, F.lit(1.0))))) * 255

    # Red is full within a sixth of a turn around 0, green around 120, blue around 240 degrees.
    return rgb(channel(0), channel(4), channel(2))


def hsl_to_rgb(c: Column) -> Column:
    chroma = (1 - F.abs(2 * c["l"] - 1)) * c["s"]
    return _from_hue(c["h"], chroma, c["l"] - chroma / 2)


def hsv_to_rgb(c: Column) -> Column:
    chroma = c["v"] * c["s"]
    return _from_hue(c["h"], chroma, c["v"] - chroma)


def hsl_to_hsv(c: Column) -> Column:
    v = c["l"] + c["s"] * F.least(c["l"], 1 - c["l"])
    return color("hsv", c["h"], F.when(v == 0, 0.0).otherwise(2 * (1 - c["l"] / v)), v)


def hsv_to_hsl(c: Column) -> Column:
    light = c["v"] * (1 - c["s"] / 2)
    room = F.least(light, 1 - light)
    return color("hsl", c["h"], F.when(room == 0, 0.0).otherwise((c["v"] - light) / room), light)


def rgb_to_cmyk(c: Column) -> Column:
    r, g, b, high, _, _ = _extremes(c)
    share = lambda x: F.when(high == 0, 0.0).otherwise((high - x) / high)
    return color("cmyk", share(r), share(g), share(b), 1 - high)


def cmyk_to_rgb(c: Column) -> Column:
    return rgb(*(255 * (1 - c[x]) * (1 - c["k"]) for x in "cmy"))


def rgb_to_yuv(c: Column) -> Column:
    r, g, b = (c[x] / 255 for x in "rgb")
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return color("yuv", y, 0.492 * (b - y), 0.877 * (r - y))


def yuv_to_rgb(c: Column) -> Column:
    r, b = c["y"] + c["v"] / 0.877, c["y"] + c["u"] / 0.492
    return rgb(*(255 * x for x in (r, (c["y"] - 0.299 * r - 0.114 * b) / 0.587, b)))


def to_linear(v: Column) -> Column:
    """The sRGB transfer curve undone, for fractions."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


#: Linear RGB to XYZ under D65, published values.
TO_XYZ = {
    "srgb": ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)),
    "display_p3": ((0.4865709, 0.2656677, 0.1982173), (0.2289746, 0.6917385, 0.0792869), (0.0, 0.0451134, 1.0439444)),
}
TO_XYZ["rec709"] = TO_XYZ["srgb"]
WHITE = (0.95047, 1.0, 1.08883)


def _times(m, v: list[Column]) -> list[Column]:
    return [sum((x * k for k, x in zip(row[1:], v[1:], strict=True)), v[0] * row[0]) for row in m]


def _inverted(m) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(m)).tolist()


def rgb_to_xyz(c: Column, primaries: str = "srgb") -> Column:
    return color("xyz", *_times(TO_XYZ[primaries], [to_linear(c[x] / 255) for x in "rgb"]))


def xyz_to_rgb(c: Column, primaries: str = "srgb") -> Column:
    return rgb(*(255 * from_linear(v) for v in _times(_inverted(TO_XYZ[primaries]), [c[x] for x in "xyz"])))


def xyz_to_lab(c: Column) -> Column:
    f = [F.when(c[x] / w > 216 / 24389, F.cbrt(c[x] / w)).otherwise((24389 / 27 * (c[x] / w) + 16) / 116) for x, w in zip("xyz", WHITE, strict=True)]
    return color("lab", 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2]))


def lab_to_xyz(c: Column) -> Column:
    y = (c["l"] + 16) / 116
    back = lambda f: F.when(f > 6 / 29, f * f * f).otherwise((116 * f - 16) * (27 / 24389))
    return color("xyz", *(back(f) * w for f, w in zip((y + c["a"] / 500, y, y - c["b"] / 200), WHITE, strict=True)))


def lab_to_lch(c: Column) -> Column:
    return color("lch", c["l"], F.sqrt(c["a"] * c["a"] + c["b"] * c["b"]), F.pmod(F.degrees(F.atan2(c["b"], c["a"])), F.lit(360.0)))


def lch_to_lab(c: Column) -> Column:
    return color("lab", c["l"], c["c"] * F.cos(F.radians(c["h"])), c["c"] * F.sin(F.radians(c["h"])))


#: OKLab's two matrices, published values: linear sRGB to cone responses, their cube roots to the space.
_OK1 = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_OK2 = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def rgb_to_oklab(c: Column) -> Column:
    cones = _times(_OK1, [to_linear(c[x] / 255) for x in "rgb"])
    return color("lab", *_times(_OK2, [F.cbrt(v) for v in cones]))


def oklab_to_rgb(c: Column) -> Column:
    roots = _times(_inverted(_OK2), [c[x] for x in "lab"])
    return rgb(*(255 * from_linear(v) for v in _times(_inverted(_OK1), [v * v * v for v in roots])))


oklab_to_oklch, oklch_to_oklab = lab_to_lch, lch_to_lab


def rgb_to_hwb(c: Column) -> Column:
    _, _, _, high, low, _ = _extremes(c)
    return color("hwb", hue(c), low, 1 - high)


def hwb_to_hsv(c: Column) -> Column:
    v = 1 - c["b"]
    return color("hsv", c["h"], F.when(v <= 0, 0.0).otherwise(1 - c["w"] / v), v)


def hsv_to_hwb(c: Column) -> Column:
    return color("hwb", c["h"], (1 - c["s"]) * c["v"], 1 - c["v"])


def _t(t) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(t)))


def mix(a: Column, b: Column, t, names: str = "rgb") -> Column:
    """Channel by channel, t held to 0 to 1."""
    return color(names, *(a[x] + (b[x] - a[x]) * _t(t) for x in names))


def mix_linear(a: Column, b: Column, t) -> Column:
    """In linear light."""
    return rgb(*(255 * from_linear(to_linear(a[x] / 255) + (to_linear(b[x] / 255) - to_linear(a[x] / 255)) * _t(t)) for x in "rgb"))


def mix_lch(a: Column, b: Column, t) -> Column:
    """With the hue on the shorter way around."""
    way = F.pmod(b["h"] - a["h"] + 180, F.lit(360.0)) - 180
    return color("lch", *(a[x] + (b[x] - a[x]) * _t(t) for x in "lc"), F.pmod(a["h"] + way * _t(t), F.lit(360.0)))


def difference(a: Column, b: Column) -> Column:
    """The Euclidean distance of two lab or oklab colours."""
    return F.sqrt(sum(((a[x] - b[x]) * (a[x] - b[x]) for x in "ab"), (a["l"] - b["l"]) * (a["l"] - b["l"])))


def luminance(c: Column) -> Column:
    r, g, b = (to_linear(c[x] / 255) for x in "rgb")
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def _soft(s: Column, d: Column) -> Column:
    lift = F.when(d <= 0.25, ((16 * d - 12) * d + 4) * d).otherwise(F.sqrt(d))
    return F.when(s <= 0.5, d - (1 - 2 * s) * d * (1 - d)).otherwise(d + (2 * s - 1) * (lift - d))


#: Blend modes by channel, source s over backdrop d, fractions.
BLENDS = {
    "normal": lambda s, d: s,
    "multiply": lambda s, d: s * d,
    "screen": lambda s, d: s + d - s * d,
    "overlay": lambda s, d: F.when(d <= 0.5, 2 * s * d).otherwise(1 - 2 * (1 - s) * (1 - d)),
    "darken": lambda s, d: F.least(s, d),
    "lighten": lambda s, d: F.greatest(s, d),
    "color_dodge": lambda s, d: F.when(d == 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), d / (1 - s))),
    "color_burn": lambda s, d: F.when(d >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - d) / s)),
    "hard_light": lambda s, d: F.when(s <= 0.5, 2 * s * d).otherwise(1 - 2 * (1 - s) * (1 - d)),
    "soft_light": _soft,
    "difference": lambda s, d: F.abs(s - d),
    "exclusion": lambda s, d: s + d - 2 * s * d,
}


def over(source: Column, source_alpha, backdrop: Column, backdrop_alpha, blend: str = "normal") -> Column:
    """Porter-Duff source over backdrop after blending: ``(r, g, b, a)``."""
    sa, da = _c(source_alpha), _c(backdrop_alpha)
    alpha = sa + da * (1 - sa)

    def channel(x: str) -> Column:
        s, d = source[x] / 255, backdrop[x] / 255
        mixed = (1 - da) * s + da * BLENDS[blend](s, d)
        return F.when(alpha == 0, 0.0).otherwise(255 * (mixed * sa + d * da * (1 - sa)) / alpha)

    return F.struct(*(channel(x).alias(x) for x in "rgb"), alpha.alias("a"))


def flatten_layers(layers: Column, blend: str = "normal") -> Column:
    """An array of ``(r, g, b, a)`` layers, the lowest first, as one."""
    empty = F.struct(*(F.lit(0.0).alias(x) for x in "rgba"))
    return F.aggregate(layers, empty, lambda below, top: over(top, top["a"], below, below["a"], blend))


def kelvin_to_rgb(k) -> Column:
    """The published fit for black bodies, held to 1000 to 40000 kelvin."""
    t = F.greatest(F.lit(1000.0), F.least(F.lit(40000.0), _c(k))) / 100
    held = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
    red = F.when(t <= 66, 255.0).otherwise(held(329.698727446 * F.pow(t - 60, F.lit(-0.1332047592))))
    green = F.when(t <= 66, held(99.4708025861 * F.ln(t) - 161.1195681661)).otherwise(held(288.1221695283 * F.pow(t - 60, F.lit(-0.0755148492))))
    blue = F.when(t >= 66, 255.0).when(t <= 19, 0.0).otherwise(held(138.5177312231 * F.ln(t - 10) - 305.0447927307))
    return rgb(red, green, blue)


def inverted(c: Column) -> Column:
    return rgb(*(255 - c[x] for x in "rgb"))


def brightened(c: Column, by) -> Column:
    return rgb(*(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c[x] * _c(by))) for x in "rgb"))


def saturated(c: Column, by) -> Column:
    h = rgb_to_hsl(c)
    return hsl_to_rgb(color("hsl", h["h"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), h["s"] * _c(by))), h["l"]))


assert math.isclose(sum(TO_XYZ["srgb"][1]), 1.0, abs_tol=1e-6)
