"""From survey documents and placemarks to pooled label tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.values import area_category, shift_back_one_day
from ..operators import geometry as GE
from ..operators import labels as L
from ..operators import ranking as R
from ..operators import tagging as TG
from ..session import stored
from ..sources import placemarks as PM
from ..sources import surveys as SV


@dataclass
class LabelTables:
    """``rows`` are the label rows without their coverage. Measuring areas writes the rings of all matches, so tables that need them are made when they are first asked for."""

    rows: DataFrame
    polygons: DataFrame
    unmatched: DataFrame
    measured: Callable[[], DataFrame]
    overlaps: Callable[[], DataFrame]

    @cached_property
    def _measured(self) -> DataFrame:
        return self.measured()

    @cached_property
    def labels(self) -> DataFrame:
        return self._measured.drop("n_polygons", "max_certainty", "row_id")

    @cached_property
    def issues(self) -> DataFrame:
        return L.consistency_issues(self._measured).drop("row_id")

    @cached_property
    def outside(self) -> DataFrame:
        return self.overlaps()


def build(docs: DataFrame, sample: DataFrame, marks: DataFrame, survey_name: str | None = None, cutoff: int = 3) -> LabelTables:
    """Label rows with coverage, enriched polygons, and the check report tables of any number of survey bundles, in one job.

    ``docs`` and ``marks`` have ``source_file``, the bundle that both belong to (or all are of ``survey_name``), ``path`` and ``position``. Bundles share internal
    ids, so every match is within one. Survey rows and polygons are numbered per bundle from 0, in the order of path, position in the file, and answer slot: later rows and later
    polygons win. Placemarks without a position (read by row) are ordered by what they say.

    Matching uses the dates as written; the date shift of one labeler comes later,
    on both pooled tables alike.
    """
    if survey_name is not None:
        docs, marks = (t.withColumn("source_file", F.lit(survey_name)) for t in (docs, marks))
    bundle = ["source_file"]
    # Documents are parsed once: tagging and numbering read their rows several times.
    survey = stored(SV.internal_ids(SV.answer_rows(docs), sample))
    survey = R.numbered_within(survey, bundle, ["path", *_position(survey), "site_id", "image_number"], "line", 0, whole="row_id").drop("path", "position")
    drawn = TG.describe_polygons(stored(PM.placemark_rows(marks).filter("geometry_status = 'ok'")))
    drawn = R.numbered_within(drawn, bundle, ["path", "position"] if "position" in drawn.columns else ["name", "description", "ring"], "poly_order", 0, whole="poly_id").drop("path", "position")
    drawn = drawn.withColumn("polygon_area_m2", G.shoelace(G.ring_to_utm("ring"))).withColumn("category", area_category())
    matches = L.survey_polygon_matches(survey, drawn, "row_id", "poly_id", bundle)
    stats = L.polygon_stats(survey, drawn, "row_id", "poly_id", bundle, cutoff, once=True)
    boxes = survey.select("row_id", G.geodesic_box("y", "x").alias("box"))
    on_row = matches.join(drawn.select("poly_id", "ring", "certainty", "category"), "poly_id")
    placed = L.repair_internal_id(L.with_polygon_site(survey, drawn, "row_id", "line", bundle), survey, bundle)
    info = ["plot_file", "x", "y", "water_source"]

    def measured() -> DataFrame:
        # Areas and statistics are left joins on their own key, so Spark leaves out what a reader of the labels does not ask for.
        return GE.site_coverage(survey.withColumn("box", G.geodesic_box("y", "x")), on_row, "row_id", cutoff).drop("box").join(stats, "row_id", "left")

    def overlaps() -> DataFrame:
        outside = GE.box_overlaps(boxes, on_row, "row_id").filter(~F.col("overlaps"))
        return outside.join(survey.select("row_id", "source_file", "line"), "row_id").drop("row_id", "poly_id")

    return LabelTables(
        rows=survey.join(stats, "row_id", "left").drop("n_polygons", "max_certainty", "row_id"),
        polygons=L.attach_survey_info(placed, survey, info, bundle).drop("poly_id"),
        unmatched=placed.filter(F.col("site_id").isNull()).drop("poly_id"),
        measured=measured,
        overlaps=overlaps,
    )


def _position(rows: DataFrame) -> list[str]:
    return [c for c in ("position",) if c in rows.columns]


def pool(labels: DataFrame) -> DataFrame:
    """Latest versions, repeats dropped, dates shifted, numbered.

    Rows are chosen and numbered by what the choice reads, which is all that is written; the rest of a row meets its number afterwards. ``source_file`` and ``line`` name a row.
    """
    place = ["source_file", "line"]
    once = chosen(labels).select(*place)
    ids = R.numbered(once, place)
    out = labels.join(ids, place).withColumn("most_recent", F.lit(1))
    return shift_back_one_day(out.select(*labels.columns, "most_recent", "unique_id"))


def chosen(labels: DataFrame) -> DataFrame:
    """What the choice of pooled label rows reads of them: rows of the latest versions, repeats dropped."""
    read = labels.select("source_file", "line", "plot_file", "site_id", *L.DATE, "operator_initials", "image_number")
    return L.drop_repeats(L.latest_versions(read), ["source_file", "line"])


def pool_polygons(polygons: DataFrame, pooled: DataFrame) -> DataFrame:
    """Polygons of the pooled survey files, dates shifted the same way. The files' names are few and go to the polygons."""
    return shift_back_one_day(polygons.join(F.broadcast(pooled.select("source_file").distinct()), "source_file", "left_semi"))
