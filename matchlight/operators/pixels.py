"""Pixel tables (image_id, row, col, red, green, blue, mask) and kernels on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RGB = ("red", "green", "blue")


# Fixed values of public standards: luma weights (here and below), sRGB to XYZ under D65, CIE Lab.


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Luma, rounded half up."""
    return F.floor(0.2989 * red + 0.5870 * green + 0.1140 * blue + 0.5).cast("int")


def with_grey(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", grey(*map(F.col, RGB)))


def hsb(red: Column, green: Column, blue: Column) -> tuple[Column, Column]:
    """Hue and saturation in single precision, 0 to 1."""
    f = lambda c: c.cast("float")
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = f(top - low)
    r, g, b = (f(top - c) / span for c in (red, green, blue))
    hue = F.when(red == top, b - g).when(green == top, F.lit(2.0).cast("float") + r - b).otherwise(F.lit(4.0).cast("float") + g - r)
    hue = f(hue) / F.lit(6.0).cast("float")
    hue = f(F.when(top == low, F.lit(0.0).cast("float")).when(hue < 0, hue + F.lit(1.0).cast("float")).otherwise(hue))
    return hue, f(F.when(top == 0, F.lit(0.0).cast("float")).otherwise(span / f(top)))


def hsv_bin(red: Column, green: Column, blue: Column) -> Column:
    """One of 100 bins: ten of hue by ten of saturation, both clamped to 0.99."""
    most = F.lit(0.99).cast("float")
    ten = F.lit(10.0).cast("float")
    hue, saturation = (F.least(x, most) for x in hsb(red, green, blue))
    return (F.floor((hue * ten).cast("float")) * 10 + F.floor((saturation * ten).cast("float"))).cast("int")


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """CIE Lab of sRGB under D65."""

    def linear(c: Column) -> Column:
        v = c / F.lit(255.0)
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = map(linear, (red, green, blue))

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise((903.3 * t + 16.0) / 116.0)

    x = curve((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.950456)
    y = curve((r * 0.2126729 + g * 0.7151522 + b * 0.0721750) / 1.0)
    z = curve((r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.088754)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def colour_index(red: Column, green: Column, blue: Column) -> Column:
    return (F.floor(red / 8) + 32 * F.floor(green / 8) + 1024 * F.floor(blue / 8)).cast("int")


def down_rows():
    return Window.partitionBy("image_id", "col").orderBy("row")


def along_cols():
    return Window.partitionBy("image_id", "row").orderBy("col")


#: Tangent, as two doubles, of the angle with the x axis at which nine times the correctly rounded phase over a turn
#: passes 3 (near 120 degrees) and 6 (near 240).
CUT_TANGENT = (1.7320508075688774, -9.118075616770985e-17)


def beyond_cut(iy: Column, ix: Column) -> Column:
    """|iy| - |ix| CUT_TANGENT, with the product in two doubles."""

    def halves(x):
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    a, b, (t, rest) = F.abs(iy), F.abs(ix), CUT_TANGENT
    (b1, b2), (t1, t2) = halves(b), halves(t)
    error = ((b1 * t1 - b * t) + b1 * t2 + b2 * t1) + b2 * t2
    return (a - b * t) - error - b * rest


def gradients(pixels: DataFrame) -> DataFrame:
    """image_id, row, col, magnitude and bin (1 to 9) of the gradient of sqrt(grey); one-sided at the borders.

    Roots of grey values meet 120 and 240 degrees, where bins end, and there libraries' arc tangents
    differ in the last bit; such rows get the bin that the correctly rounded one gives, by CUT_TANGENT.
    """
    x = with_grey(pixels).withColumn("v", F.sqrt(F.col("gray").cast("double")))

    def slope(window) -> Column:
        before, after = F.lag("v").over(window), F.lead("v").over(window)
        return F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise(after - before)

    x = x.withColumns({"iy": slope(along_cols()), "ix": slope(down_rows())})
    phase = F.atan2("iy", "ix")
    turns = 9 * F.when(phase < 0, phase + 2 * 3.141592653589793).otherwise(phase) / (2 * 3.141592653589793)
    past = beyond_cut(F.col("iy"), F.col("ix"))
    near = lambda k: F.abs(turns - k) < 1e-9
    grid_bin = F.greatest(F.lit(1), F.least(F.lit(9), F.ceil(turns)))
    grid_bin = F.when(near(3), F.when(past >= 0, 3).otherwise(4)).when(near(6), F.when(past <= 0, 6).otherwise(7)).otherwise(grid_bin)
    return x.withColumns({"magnitude": F.sqrt(F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy")), "bin": grid_bin.cast("int")})


def siltp(pixels: DataFrame, radius: int, tolerance: float = 0.3) -> DataFrame:
    """pixels with code, the ternary pattern of four neighbours at the radius; borders repeat the edge."""
    x = with_grey(pixels)
    rows, cols = down_rows(), along_cols()
    far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    right = F.coalesce(F.lead("gray", radius).over(cols), F.last("gray").over(far(cols)))
    left = F.coalesce(F.lag("gray", radius).over(cols), F.first("gray").over(far(cols)))
    up = F.coalesce(F.lag("gray", radius).over(rows), F.first("gray").over(far(rows)))
    down = F.coalesce(F.lead("gray", radius).over(rows), F.last("gray").over(far(rows)))
    g = F.col("gray").cast("double")
    ternary = lambda n: F.when(n < (1 - tolerance) * g, 1).when(n > (1 + tolerance) * g, 2).otherwise(0)
    x = x.withColumns({"n0": right, "n1": up, "n2": left, "n3": down})
    code = sum((ternary(F.col(f"n{i}")) * 3**i for i in range(4)), F.lit(0))
    return x.withColumn("code", code.cast("int")).drop("n0", "n1", "n2", "n3")


def resize_nearest(pixels: DataFrame, factor: int = 4) -> DataFrame:
    """Every pixel as a block of factor by factor."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    x = pixels.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    return x.withColumns({"row": F.col("row") * factor + F.col("dr"), "col": F.col("col") * factor + F.col("dc")}).drop("dr", "dc")


def resize_bicubic(pixels: DataFrame, factor: int = 4) -> DataFrame:
    """Catmull-Rom interpolation per image; images are independent groups."""
    import numpy as np
    import pandas as pd

    def weights(n: int) -> "np.ndarray":
        at = (np.arange(n * factor) + 0.5) / factor - 0.5
        w = np.zeros((n * factor, n))
        for k in range(-1, 3):
            i = np.floor(at).astype(int) + k
            t = np.abs(at - i)
            v = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
            np.add.at(w, (np.arange(n * factor), np.clip(i, 0, n - 1)), v)
        return w

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        rows, cols = np.divmod(np.arange(h * factor * w * factor), w * factor)
        out = {"image_id": pdf["image_id"].iloc[0], "row": rows, "col": cols}
        for c in RGB:
            grid = np.zeros((h, w))
            grid[pdf["row"], pdf["col"]] = pdf[c]
            out[c] = np.clip(np.floor(weights(h) @ grid @ weights(w).T + 0.5), 0, 255).astype(int).ravel()
        return pd.DataFrame(out)

    return pixels.groupBy("image_id").applyInPandas(one, "image_id long, row int, col int, red int, green int, blue int")
