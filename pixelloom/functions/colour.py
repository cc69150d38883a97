"""Per-pixel colour arithmetic: as column expressions (which stay inside codegen), and up to
``likelihood`` as well on whole arrays. The evidence of a pixel is an expression too long
for the JVM to compile, so ``stages.evidence`` takes arrays; both give the same doubles."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of pixels: a column, or an array.
Values = Column | np.ndarray


def _least(*v: Values) -> Values:
    return F.least(*v) if isinstance(v[0], Column) else reduce(np.minimum, v)


def _greatest(*v: Values) -> Values:
    return F.greatest(*v) if isinstance(v[0], Column) else reduce(np.maximum, v)


def _either(condition: Values, a: Values | float, b: Values | float) -> Values:
    return F.when(condition, a).otherwise(b) if isinstance(condition, Column) else np.where(condition, a, b)


def _real(v: Values) -> Values:
    return v.cast("double") if isinstance(v, Column) else v.astype(float)


def clip01(x: Values) -> Values:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if isinstance(x, Column) else np.clip(x, 0.0, 1.0)


def ramp_up(v: Values, lo: float, hi: float) -> Values:
    """0 at lo or less, 1 at hi or more, straight between; a step where hi <= lo."""
    if hi <= lo:
        return _either(v >= lo, 1.0, 0.0)
    return clip01((v - float(lo)) / float(hi - lo))


def ramp_down(v: Values, lo: float, hi: float) -> Values:
    return 1.0 - ramp_up(v, lo, hi)


def band(v: Values, lo: float, hi: float, soft: float) -> Values:
    """1 from lo to hi with soft edges outside."""
    return _least(ramp_up(v, lo - soft, lo), ramp_down(v, hi, hi + soft))


def gate(signal: Values, support: Values, floor: float) -> Values:
    """What a signal is worth where texture supports it only in part."""
    return signal * (floor + (1.0 - floor) * support)


def half_up(x: Values) -> Values:
    """Nearest integer, as an int, equal in every engine for x >= 0."""
    return F.floor(x + F.lit(0.5)).cast("int") if isinstance(x, Column) else np.floor(x + 0.5).astype(np.int64)


def hue(b: Values, g: Values, r: Values) -> Values:
    """Hue in half degrees, 0 to 179."""
    top, low = _greatest(b, g, r), _least(b, g, r)
    d = _real(top - low)
    if not isinstance(d, Column):
        d = np.where(d == 0, 1.0, d)
    degrees = _either(top == low, 0.0, _either(top == r, 60.0 * (g - b) / d, _either(top == g, 120.0 + 60.0 * (b - r) / d, 240.0 + 60.0 * (r - g) / d)))
    return half_up(_either(degrees < 0, degrees + 360.0, degrees) / 2.0) % 180


def saturation(b: Values, g: Values, r: Values) -> Values:
    top, low = _greatest(b, g, r), _least(b, g, r)
    return _either(top == 0, 0, half_up(255.0 * (top - low) / (top if isinstance(top, Column) else np.maximum(top, 1))))


def value(b: Values, g: Values, r: Values) -> Values:
    top = _greatest(b, g, r)
    return top.cast("int") if isinstance(top, Column) else top


def gray(b: Column, g: Column, r: Column) -> Column:
    return half_up((F.lit(114) * b + F.lit(587) * g + F.lit(299) * r) / F.lit(1000.0))


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """CIE L (0 to 100), a and b of sRGB under D65."""

    def linear(c: Column) -> Column:
        x = c / F.lit(255.0)
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    lb, lg, lr = linear(b), linear(g), linear(r)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return light, 500.0 * (f(x) - f(y)), 200.0 * (f(y) - f(z))


def lab8(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Lab in whole numbers from 0 to 255."""
    light, a, bb = lab(b, g, r)
    return half_up(light * F.lit(255.0 / 100.0)), half_up(a + 128.0), half_up(bb + 128.0)


def from_lab8(light: Column, a: Column, b_: Column) -> tuple[Column, Column, Column]:
    """B, G, R of Lab in whole numbers from 0 to 255."""
    fy = (light * F.lit(100.0 / 255.0) + 16.0) / 116.0
    fx, fz = fy + (a - 128.0) / 500.0, fy - (b_ - 128.0) / 200.0
    cubed = lambda f: F.when(f > 6.0 / 29.0, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)
    x, y, z = 0.950456 * cubed(fx), cubed(fy), 1.088754 * cubed(fz)

    def byte(v: Column) -> Column:
        v = clip01(v)
        return half_up(255.0 * F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055))

    blue, green, red = 0.055648 * x - 0.204043 * y + 1.057311 * z, -0.969256 * x + 1.875991 * y + 0.041556 * z, 3.240479 * x - 1.537150 * y - 0.498535 * z
    return byte(blue), byte(green), byte(red)


HSV = tuple[Values, Values, Values]


def not_red(b: Values, g: Values, r: Values) -> Values:
    return ramp_up(b - _greatest(g, r), -4, 2)


def _hsv(b: Values, g: Values, r: Values) -> HSV:
    return hue(b, g, r), saturation(b, g, r), value(b, g, r)


def blue_cue(b: Values, g: Values, r: Values, hsv: HSV | None = None) -> Values:
    h, s, v = hsv or _hsv(b, g, r)
    lit_ = ramp_up(v, 10, 25)
    by_hue = _least(band(h, 85, 135, 8), ramp_up(s, 20, 35), lit_) * not_red(b, g, r)
    return _greatest(by_hue, _least(ramp_up(b - _greatest(g, r), 0, 6), lit_))


def turbid_cue(b: Values, g: Values, r: Values, hsv: HSV | None = None) -> Values:
    h, s, v = hsv or _hsv(b, g, r)
    return _least(band(h, 5, 35, 6), band(s, 25, 215, 20), band(v, 35, 255, 20))


def dark_cue(b: Values, g: Values, r: Values, hsv: HSV | None = None) -> Values:
    _, s, v = hsv or _hsv(b, g, r)
    return _least(ramp_down(v, 50, 70), ramp_down(s, 80, 110))


def pale_cue(b: Values, g: Values, r: Values, hsv: HSV | None = None) -> Values:
    _, s, v = hsv or _hsv(b, g, r)
    return _least(ramp_down(s, 30, 45), band(v, 55, 235, 20))


def vegetation(b: Values, g: Values, r: Values, hsv: HSV | None = None) -> Values:
    h, s, _ = hsv or _hsv(b, g, r)
    excess = (2 * g - r - b) / _real(_greatest(b + g + r, F.lit(1) if isinstance(b, Column) else 1))
    return _greatest(_least(band(h, 36, 84, 6), ramp_up(s, 30, 45)), ramp_up(excess, 0.02, 0.14))


def likelihood(b: Values, g: Values, r: Values, support: Values, hsv: HSV | None = None) -> Values:
    """Water evidence, 0 to 1: the strongest gated cue less vegetation."""
    best = _greatest(
        gate(blue_cue(b, g, r, hsv), support, 0.27),
        gate(turbid_cue(b, g, r, hsv), support, 0.05),
        gate(dark_cue(b, g, r, hsv), support, 0.15),
        gate(pale_cue(b, g, r, hsv), support, 0.12),
    )
    return clip01(best - 0.45 * vegetation(b, g, r, hsv))


def support(chroma_std: Column, gray_std: Column, edges: Column) -> Column:
    """How smooth the surroundings are, 0 to 1."""
    return clip01(0.40 * ramp_down(chroma_std, 6, 16) + 0.20 * ramp_down(gray_std, 10, 34) + 0.40 * ramp_down(edges, 0.05, 0.22))
