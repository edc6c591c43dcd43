"""Stacks: inventory, band choice, pixel rows and flattening."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import regex_or_null

# Band order of the two stores.
BAND_NAMES = ["B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12", "NDVI", "EVI", "NDWI", "SCL"]
S2_BANDS = BAND_NAMES[:10]
PS_BANDS = ["blue", "green", "red", "nir"]
WINDOWS = 42


def band_columns(bands: Sequence[str | int]) -> list[str]:
    """Column names of band names or positions; unknown ones raise."""
    out = []
    for b in bands:
        if isinstance(b, bool) or not isinstance(b, (int, str)):
            raise ValueError(f"a band is a name or a position, not {type(b).__name__}")
        if isinstance(b, int):
            out.append(BAND_NAMES[b])
        elif b in BAND_NAMES:
            out.append(b)
        else:
            raise ValueError(f"unknown band {b!r}")
    return out


def select_bands(df: DataFrame, bands: Sequence[str | int], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *band_columns(bands))


def with_stack_path(rows: DataFrame, stacks: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows that have a stack, with its path."""
    return rows.join(stacks.select(key, "stack_path"), key)


def stack_inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """Site, date, kind, sensor folder, version and labeler of every stack or label file name; other columns stay."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    folder = F.split(F.col(path), "/")
    label = r"^\d+_\d{4}\.\d{2}\.\d{2}_([A-Z]+)_labels"
    return paths.select(
        "*", name.alias("name"),
        regex_or_null(name, r"^(\d+)_\d{4}\.\d{2}\.\d{2}_").alias("site"),
        F.try_to_date(regex_or_null(name, r"^\d+_(\d{4}\.\d{2}\.\d{2})_"), "yyyy.MM.dd").alias("image_date"),
        F.when(name.rlike(r"_stack_masked\."), "stack_masked").when(name.rlike(r"_stack\."), "stack")
        .when(name.rlike(label), "labels").when(name.rlike(r"_metadata\.json$"), "metadata").alias("kind"),
        regex_or_null(name, label).alias("operator_initials"),
        F.try_element_at(folder, F.lit(-2)).alias("version"),
        F.try_element_at(folder, F.lit(-3)).alias("sensor"),
    ).filter(F.col("site").isNotNull() & F.col("kind").isNotNull())


def latest_version(inventory: DataFrame, version: str = "version") -> DataFrame:
    """Rows of the greatest version name; a scalar subquery, so a version partition is pruned."""
    newest = inventory.agg(F.max(version)).scalar()
    return inventory.filter(F.col(version) == newest)


def available_sources(sources: Mapping[str, DataFrame], labels: DataFrame,
                      keys: Sequence[str] = ("site_id", "image_date")) -> DataFrame:
    """One row per site and date with a flag per source and the labelers.

    All inventories are stacked and grouped once: one shuffle however many sources.
    """
    tall = [df.select(*keys, F.lit(n).alias("__s"), F.lit(None).cast("string").alias("__l")) for n, df in sources.items()]
    tall.append(labels.select(*keys, F.lit("").alias("__s"), F.col("operator_initials").alias("__l")))
    one = reduce(DataFrame.unionByName, tall).distinct()
    return one.groupBy(*keys).agg(
        *[F.bool_or(F.col("__s") == n).alias(n) for n in sources],
        F.array_join(F.array_sort(F.collect_set("__l")), ";").alias("labelers"),
    )


def in_both(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys present in both inventories, first ``limit`` in key order."""
    return a.select(*keys).intersect(b.select(*keys)).orderBy(*keys).limit(limit)


def layers_to_cells(df: DataFrame, layers: str, steps: int, bands: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Band-major layer array (``layer = band * steps + step``) to one row per step, a column per band.

    Zero is no data and becomes NULL.
    """
    def at(band: int, t: Column) -> Column:
        return F.nullif(F.element_at(layers, (F.lit(band * steps) + t + 1).cast("int")), F.lit(0))

    t = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t")
    return df.select(*keep, layers, t).select(*keep, "t", *[at(i, F.col("t")).alias(b) for i, b in enumerate(bands)])


def cells_to_layers(df: DataFrame, keys: Sequence[str], bands: Sequence[str], nodata: int = 0) -> DataFrame:
    """Back to one band-major array per key, steps in order, NULL as no data."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("t"), *bands)))
    g = df.groupBy(*keys).agg(packed.alias("__p"))

    def column(b):
        return F.transform("__p", lambda x: F.coalesce(x[b], F.lit(nodata)))

    return g.select(*keys, F.concat(*[column(b) for b in bands]).alias("layers"))


def replace_missing(df: DataFrame, cols: Sequence[str], sentinel: int = -9999, value: float | None = 0.0) -> DataFrame:
    """Sentinel to NULL (value=None) or to a number."""
    fill = F.lit(None) if value is None else F.lit(value)
    return df.withColumns({c: F.when(F.col(c) == sentinel, fill).otherwise(F.col(c)) for c in cols})


def flatten_pixels(px: DataFrame, bands: Sequence[str], steps: Sequence[int],
                   keys: Sequence[str] = ("file_id", "row", "col")) -> DataFrame:
    """One row per pixel with a column per step and band, from a fixed list so no extra pass finds the values.

    A repeated cell keeps its greatest value.
    """
    return px.groupBy(*keys).agg(*[
        F.max(F.when(F.col("t") == t, F.col(b))).alias(f"{b}_t{t}") for t in steps for b in bands
    ])


def flatten_cells(px: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("file_id", "t", "row", "col")) -> DataFrame:
    """One row per band, step and pixel; missing cells dropped."""
    return px.select(*keys, *bands).unpivot(list(keys), list(bands), "band", "value").filter(F.col("value").isNotNull())


def nan_counts(px: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Missing pixels per file, band and step, with totals over files, by one rollup-like grouping."""
    long = px.select("file_id", "t", *bands).unpivot(["file_id", "t"], list(bands), "band", "value")
    missing = F.count_if(F.col("value").isNull()).alias("n_missing")
    return long.groupingSets([["file_id", "band", "t"], ["band", "t"]], "file_id", "band", "t").agg(missing)


def nan_table(counts: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Bands down, steps across."""
    total = counts.filter(F.col("file_id").isNull())
    return total.groupBy("band").pivot("t", list(steps)).agg(F.max("n_missing")).fillna(0)


def load_listed(stems: DataFrame, manifest: DataFrame, pixels: DataFrame, label_bands: Sequence[str],
                key: str = "stem") -> DataFrame:
    """Pixels of the listed stems with the chosen label bands only."""
    wanted = stems.select(key).distinct().join(manifest.select(key).distinct(), key)
    return pixels.select(key, "row", "col", *label_bands).join(wanted, key)


def load_report(stems: DataFrame, manifest: DataFrame, pixels: DataFrame, key: str = "stem") -> DataFrame:
    """Counts of listed, not in the manifest, without pixels, and loaded stems."""
    s = stems.select(key).distinct()
    m = manifest.select(key, F.lit(True).alias("__m")).distinct()
    p = pixels.select(key, F.lit(True).alias("__p")).distinct()
    j = s.join(m, key, "left").join(p, key, "left")
    return j.agg(
        F.count("*").alias("listed"), F.count_if(F.col("__m").isNull()).alias("not_in_manifest"),
        F.count_if(F.col("__m") & F.col("__p").isNull()).alias("without_pixels"),
        F.count_if(F.col("__m") & F.col("__p")).alias("loaded"),
    )


def pair_by_uid(images: DataFrame, masks: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Image and mask of one uid, both needed; the JSON side file is optional."""
    return images.join(masks, "uid").join(sidecars, "uid", "left")


def pair_preferred(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Image with its label file; a labeler's own file is preferred to the plain one.

    ``labels``: pair_id, label_path, is_variant. The preference is an aggregate,
    so a pair id with many files is combined on the map side.
    """
    best = labels.groupBy("pair_id").agg(
        F.min_by("label_path", F.struct(~F.col("is_variant"), F.col("label_path"))).alias("label_path"))
    return images.join(best, "pair_id")


def scene_mask_pairs(files: DataFrame, name: str = "name") -> DataFrame:
    """Analytic scene files with their usable-pixel mask by scene id; the mask is optional."""
    n = F.col(name)
    scene = F.when(n.contains("_3B_"), F.element_at(F.split(n, "_3B_"), 1)).otherwise(F.regexp_replace(n, r"\.tif$", ""))
    low = F.lower(n)
    f = files.select(scene.alias("scene_id"), n.alias("file"), low.contains("udm2").alias("is_mask"),
                     (n.contains("AnalyticMS") | low.contains("analytic")).alias("is_image"))
    img = f.filter(F.col("is_image") & ~F.col("is_mask")).groupBy("scene_id").agg(F.max("file").alias("image_file"))
    msk = f.filter("is_mask").groupBy("scene_id").agg(F.max("file").alias("mask_file"))
    return img.join(msk, "scene_id", "left")
