"""Column expressions for fluxes, magnitudes, flags, names and angles. NULL stands for every kind of missing value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN10 = math.log(10.0)
#: Band limits of the older survey and zero points of the star catalogue.
LIMITS = {"g": 23.3, "r": 23.2, "i": 23.1}
#: Texts that stand for a missing value.
SENTINELS = ("False", "", "-999", "-999.0", "--", "n", "-9999.0", "nan", "b''")
STAR_ZERO_POINTS = {"g": 25.8010, "bp": 25.3540, "rp": 25.1040}


def clean(x: Column) -> Column:
    """NaN, infinities and the sentinel -999 become NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")) & (x != -999.0), x)


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with NULL for every missing value in these columns: SENTINELS in texts, False, and in numbers what clean() takes for one."""
    kinds, out = dict(df.dtypes), {}
    for name in columns:
        x = F.col(name)
        if kinds[name] == "string":
            out[name] = F.when(~x.isin(*SENTINELS), x)
        elif kinds[name] == "boolean":
            out[name] = F.when(x, x)
        else:
            missing = F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")) | x.cast("double").isin(-999.0, -9999.0)
            out[name] = F.when(~missing, x)
    return df.withColumns(out)


def flux_to_mag(flux: Column, zp: Column | float) -> Column:
    return F.when(flux > 0, -2.5 * F.log10(flux) + zp)


def flux_to_mag_err(flux: Column, err: Column) -> Column:
    return F.when(flux > 0, 2.5 * err / (LN10 * flux))


def mag_to_flux(mag: Column, zp: Column | float) -> Column:
    return F.pow(F.lit(10.0), (mag - zp) / -2.5)


def mag_to_flux_err(flux: Column, mag_err: Column) -> Column:
    return mag_err * LN10 * flux / 2.5


def snr(mag: Column, mag_err: Column) -> Column:
    return F.when(mag.isNotNull(), F.try_divide(F.lit(2.5 / LN10), mag_err))


def julian_year_to_mjd(year: Column) -> Column:
    return 51544.5 + (year - 2000) * 365.25


def effective_mags(flag: Column) -> tuple[Column, Column]:
    """Magnitudes of A and B with limits for what one survey alone has seen: flag 1 is A alone, 2 is B alone."""
    limit = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])[F.col("band")]
    return F.when(flag == 2, F.col("mag_limit")).otherwise(F.col("psf_mag")), F.when(flag == 1, limit).otherwise(F.col("mag"))


def any_bit(flags: Column, *bits: int) -> Column:
    mask = 0
    for b in bits:
        mask |= b
    return F.coalesce(flags.cast("long"), F.lit(0).cast("long")).bitwiseAND(F.lit(mask).cast("long")) != 0


def holds(predicate: Column) -> Column:
    """A predicate that an unknown value fails."""
    return F.coalesce(predicate, F.lit(False))


def coord_stem(ra: Column, dec: Column) -> Column:
    return F.translate(F.format_string("%.4f_%.4f", ra, dec), ".-", "pn")


def parse_coord_stem(stem: Column) -> tuple[Column, Column]:
    pattern = r"^(?:\d+_)?(n?\d+(?:p\d+)?)_(n?\d+(?:p\d+)?)$"
    def part(i):
        s = F.regexp_extract(stem, pattern, i)
        return F.when(s != "", F.translate(s, "pn", ".-").cast("double"))
    return part(1), part(2)


def two_significant(x: Column) -> Column:
    """Half up to two significant figures; 0 stays 0."""
    places = 1 - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), places)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale)


def flux_unit_scale(unit: Column) -> Column:
    number = F.regexp_extract(unit, r"^(1[Ee][+-]?\d+) erg/cm\^2/s/Angstrom$", 1)
    return F.when(number != "", number.cast("double")).otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), unit)).cast("double"))


def filter_code(band: Column) -> Column:
    return F.when(F.length(band) == 1, F.concat(F.lit("z"), band)).otherwise(band)


def mean_ra(a: Column, b: Column) -> Column:
    """The middle of two right ascensions, also across 0."""
    x, y = F.cos(F.radians(a)) + F.cos(F.radians(b)), F.sin(F.radians(a)) + F.sin(F.radians(b))
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def propagated(ra: Column, dec: Column, pmra: Column, pmdec: Column, years: Column | float) -> tuple[Column, Column]:
    """A position after proper motion (mas a year, unknown is none): a step in the tangent plane of the unit vector."""
    a, d = F.radians(ra), F.radians(dec)
    east, north = (F.coalesce(x, F.lit(0.0)) * years * (math.pi / 180 / 3.6e6) for x in (pmra, pmdec))
    x = F.cos(d) * F.cos(a) - east * F.sin(a) - north * F.sin(d) * F.cos(a)
    y = F.cos(d) * F.sin(a) + east * F.cos(a) - north * F.sin(d) * F.sin(a)
    z = F.sin(d) + north * F.cos(d)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0, F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def healpix_nested(ra: Column, dec: Column, order: int) -> Column:
    """The nested pixel number of a position (Gorski et al. 2005)."""
    n = 1 << order
    z = F.sin(F.radians(dec))
    tt = (ra % 360.0) / 90.0
    za = F.abs(z)
    jp, jm = F.floor(n * (0.5 + tt) - n * z * 0.75), F.floor(n * (0.5 + tt) + n * z * 0.75)
    ifp, ifm = F.floor(jp / n), F.floor(jm / n)
    face_eq = F.when(ifp == ifm, F.when(ifp == 4, 4).otherwise(ifp + 4)).when(ifp < ifm, ifp).otherwise(ifm + 8)
    ntt = F.least(F.floor(tt), F.lit(3))
    tp = tt - ntt
    tmp = n * F.sqrt(3.0 * (1.0 - za))
    jpp, jmp = F.least(F.floor(tp * tmp), F.lit(n - 1)), F.least(F.floor((1.0 - tp) * tmp), F.lit(n - 1))
    eq = za <= 2.0 / 3.0
    face = F.when(eq, face_eq).when(z >= 0, ntt).otherwise(ntt + 8).cast("long")
    ix = F.when(eq, F.pmod(jm, F.lit(n))).when(z >= 0, n - jmp - 1).otherwise(jpp).cast("long")
    iy = F.when(eq, n - F.pmod(jp, F.lit(n)) - 1).when(z >= 0, n - jpp - 1).otherwise(jmp).cast("long")
    pix = face * (n * n)
    for b in range(order):
        pix = pix + F.shiftleft(F.shiftright(ix, b).bitwiseAND(1), 2 * b) + F.shiftleft(F.shiftright(iy, b).bitwiseAND(1), 2 * b + 1)
    return pix


def luminosity_distance(z: Column, h0: float = 70.0, matter: float = 0.3, steps: int = 64) -> Column:
    """Mpc in a flat universe, by Simpson's rule."""
    def term(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        x = 1 + z * i / steps
        return total + weight / F.sqrt(matter * x * x * x + (1 - matter))
    integral = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), term)
    return (1 + z) * 299792.458 / h0 * z / (3 * steps) * integral


def absolute_mag(mag: Column, z: Column) -> Column:
    """Absolute magnitude with the K correction of a flat spectrum, -2.5 log10(1 + z)."""
    return mag - 5 * (F.log10(1e6 * luminosity_distance(z)) - 1) + 2.5 * F.log10(1 + z)
