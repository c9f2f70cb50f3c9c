"""Light curves of eight surveys in common columns: a spec for each, compiled to one projection, and what makes one series of its rows.

A survey's table has `source`, the target that its rows were found for, and `seq`, the order in which they were found.
The spec says which columns are its id, time and position and how its magnitudes are given: a column for each band, a
row for each band under filter numbers, or fluxes with zero points. The common columns are source, survey, seq,
{survey}_id, ra, dec, mjd and {band}_mag, {band}_magerr, {band}_snr; NaN and infinities are NULL there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.photometry import STAR_ZERO_POINTS, clean, flux_to_mag, flux_to_mag_err, julian_year_to_mjd
from .lightcurve import anchored, same_night
from .spatial import separation

#: Arc seconds from the mean position within which rows under different ids are of one object.
NEAR = 1.5
DAYS = 3.0


@dataclass(frozen=True)
class Survey:
    name: str
    id: str
    time: str = "mjd"
    years: bool = False  # whether time is a Julian year
    position: bool = True
    wide: dict[str, tuple[str, str]] = field(default_factory=dict)  # band: magnitude and error
    rows: tuple[str, str, str, dict[str, str]] | None = None  # filter, magnitude, error, and the band of each filter
    fluxes: dict[str, tuple[str, str, float]] = field(default_factory=dict)  # band: flux, error, zero point
    snr: dict[str, tuple[str, str | None]] = field(default_factory=dict)  # band: flux and error, or the ratio itself
    same: str = "id"  # rows of one object: those of the first row's id, or those near the mean position
    collapse: str | None = None  # nights: rows of a band within a day; windows: means in windows of DAYS

    @property
    def bands(self) -> list[str]:
        return [*self.wide, *(dict.fromkeys(self.rows[3].values()) if self.rows else ()), *self.fluxes]

    def needs(self) -> set[str]:
        used = {"source", "seq", self.id, self.time, *(("ra", "dec") if self.position else ()), *(self.rows[:3] if self.rows else ())}
        return used | {c for pair in self.wide.values() for c in pair} | {c for f in self.fluxes.values() for c in f[:2]} | {c for pair in self.snr.values() for c in pair if c}


#: What the surveys call their columns and filters. Two bands of PTF are named after it, as g and G are one name in Spark.
SURVEYS = {
    s.name: s
    for s in (
        Survey("ztf", "oid", rows=("filtercode", "mag", "magerr", {"zg": "g", "zr": "r", "zi": "i"}), same="near"),
        Survey("wise", "source_id_mf", wide={f"w{n}": (f"w{n}mpro_ep", f"w{n}sigmpro_ep") for n in range(1, 5)}, snr={f"w{n}": (f"w{n}flux_ep", f"w{n}sigflux_ep") for n in range(1, 5)}, collapse="windows"),
        Survey("neowise", "source_id", wide={f"w{n}": (f"w{n}mpro", f"w{n}sigmpro") for n in (1, 2)}, snr={f"w{n}": (f"w{n}snr", None) for n in (1, 2)}),
        Survey("ptf", "oid", "obsmjd", rows=("fid", "mag_autocorr", "magerr_auto", {"1": "ptf_G", "2": "ptf_R"})),
        Survey("sdss", "objID", wide={f"{b}{k.title()}": (f"{k}Mag_{b}", f"{k}Magerr_{b}") for b in "ugriz" for k in ("psf", "model")}),
        Survey("panstarrs", "objID", "obsTime", rows=("filterID", "mag", "magerr", {"1": "pstarr_g", "2": "pstarr_r", "3": "pstarr_i", "4": "pstarr_z", "5": "pstarr_y"}), collapse="nights"),
        Survey("gaia", "source_id", "ref_epoch", years=True, fluxes={f"gaia_{b}": (f"phot_{b}_mean_flux", f"phot_{b}_mean_flux_error", STAR_ZERO_POINTS[b]) for b in ("g", "rp", "bp")}),
        Survey("custom", "custom_id", position=False, rows=("filter", "custom_mag", "custom_magerr", {b: f"custom_{b}" for b in "griz"})),
    )
}


def compiled(df: DataFrame, survey: Survey) -> DataFrame:
    """The common columns of a survey's table, one projection. A column that the spec needs and the table lacks is an error."""
    if lost := survey.needs() - set(df.columns):
        raise ValueError(f"{survey.name}: no column {', '.join(sorted(lost))}")
    text = {c for c, kind in df.dtypes if kind in ("string", "binary", "boolean", "date")} | {c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct", "timestamp"))}
    if wrong := text & (survey.needs() - {"source", "seq", survey.id, *(survey.rows[:1] if survey.rows else ())}):
        raise ValueError(f"{survey.name}: not a number: {', '.join(sorted(wrong))}")
    mags: dict[str, tuple[Column, Column]] = {b: (F.col(m), F.col(e)) for b, (m, e) in survey.wide.items()}
    if survey.rows:
        name, mag, err, filters = survey.rows
        for i, b in filters.items():
            mine = F.col(name).cast("string") == i
            mags[b] = (F.when(mine, F.col(mag)), F.when(mine, F.col(err)))
    for b, (flux, err, zp) in survey.fluxes.items():
        mags[b] = (flux_to_mag(F.col(flux), zp), flux_to_mag_err(F.col(flux), F.col(err)))
    time = julian_year_to_mjd(F.col(survey.time)) if survey.years else F.col(survey.time)
    place = [clean(F.col(c)) if survey.position else F.lit(None).cast("double") for c in ("ra", "dec")]
    out = [F.col("source"), F.lit(survey.name).alias("survey"), F.col("seq"), F.col(survey.id).alias(f"{survey.name}_id"), place[0].alias("ra"), place[1].alias("dec"), clean(time).alias("mjd")]
    for b, (mag, err) in mags.items():
        out += [clean(mag).alias(f"{b}_mag"), clean(err).alias(f"{b}_magerr")]
    for b, (flux, err) in survey.snr.items():
        out.append(clean(F.col(flux) if err is None else F.try_divide(F.col(flux).cast("double"), F.col(err).cast("double"))).alias(f"{b}_snr"))
    return df.select(out)


def same_object(df: DataFrame, survey: Survey) -> DataFrame:
    """Rows of one object for each source: within NEAR of the rows' mean position, or under the id of the first row."""
    w = Window.partitionBy("source")
    if survey.same == "near":
        a = F.radians("ra")
        mean = (F.degrees(F.atan2(F.avg(F.sin(a)).over(w), F.avg(F.cos(a)).over(w))) + 360.0) % 360.0
        near = df.withColumns({"_ra": mean, "_dec": F.avg("dec").over(w)})
        return near.filter(separation(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec")) < NEAR).drop("_ra", "_dec")
    name = f"{survey.name}_id"
    first = df.groupBy("source").agg(F.min_by(F.struct(name), "seq").alias("_f"))
    return df.join(first, "source").filter(F.col(name).eqNullSafe(F.col(f"_f.{name}"))).drop("_f")


def one_series(df: DataFrame, survey: Survey) -> DataFrame:
    """Rows of one object, collapsed as the survey's spec says; a collapsed row has the id and place of its first."""
    df, name = same_object(df, survey), f"{survey.name}_id"
    if survey.collapse == "windows":
        means = [c for c in df.columns if c not in ("source", "survey", "seq", name)]
        first = F.min_by(F.struct("seq", name), F.struct("mjd", "seq")).alias("_f")
        w = anchored(df.filter("mjd is not null").withColumn("jd", F.col("mjd")), ["source"], DAYS)
        w = w.groupBy("source", "survey", "t0").agg(first, *[F.avg(c).alias(c) for c in means])
        return w.select(*[F.col(f"_f.{c}").alias(c) if c in ("seq", name) else F.col(c) for c in df.columns])
    if survey.collapse == "nights":
        band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"{b}_mag").alias("flux"), F.col(f"{b}_magerr").alias("flux_unc")) for b in survey.bands])).alias("_b")
        rows = df.select("source", "survey", name, "ra", "dec", F.col("mjd").alias("jd"), F.col("seq").alias("event_id"), band).select("*", "_b.*").drop("_b").filter("flux is not null and jd is not null")
        night = same_night(rows, ["source", "band"], first=["survey", name, "ra", "dec", "event_id"])
        mags = [F.when(F.col("band") == b, F.col(x)).alias(f"{b}_{y}") for b in survey.bands for x, y in (("flux", "mag"), ("flux_unc", "magerr"))]
        return night.select("source", "survey", F.col("event_id").alias("seq"), name, "ra", "dec", F.col("jd").alias("mjd"), *mags)
    return df


def assembled(tables: dict[str, DataFrame]) -> DataFrame:
    """The light curves of all sources out of the tables of their surveys, by name: ids first, then place, time and what was measured."""
    parts = [one_series(compiled(df, SURVEYS[name]), SURVEYS[name]) for name, df in tables.items()]
    return tidy(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def tidy(df: DataFrame) -> DataFrame:
    ids = [c for c in df.columns if c.endswith("_id")]
    rest = [c for c in df.columns if c in ("ra", "dec", "mjd") or c.endswith(("_mag", "_magerr", "_snr"))]
    return df.select("source", "survey", *ids, *rest)
