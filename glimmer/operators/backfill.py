"""Copies between stores, clean-up, context rows, assembled texts, small conversions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.operators import scans


def backfill(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it lacks (of repeated ones the smallest row); running it again adds nothing."""
    rest = [c for c in target.columns if c != key]
    new = source.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return target.unionByName(new.join(target, key, "left_anti").select(*target.columns))


def copy_vectors(vectors: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Vectors of the given items only."""
    return vectors.join(items.select(key), key, "left_semi")


def missing_by_type(source: DataFrame, target: DataFrame, key: str, kind: str) -> DataFrame:
    return source.join(target, key, "left_anti").groupBy(kind).agg(F.count(F.lit(1)).alias("missing"))


def segment_rows(segments: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """Segments as catalog rows in milliseconds: their item is found by their own path, else by their video file's path; those without one are left out."""
    by = lambda p: items.groupBy("path").agg(F.min("id").alias(f"id_{p}"), F.min_by("created_at", "id").alias(f"at_{p}")).withColumnRenamed("path", f"path_{p}")
    s = segments.join(by("own"), F.col("video_path") == F.col("path_own"), "left").join(files.select(F.col("id").alias("video_id"), "file_path"), "video_id", "left").join(by("file"), F.col("file_path") == F.col("path_file"), "left")
    ms = lambda c: F.round(F.col(c) * 1000.0).cast("long")
    return s.select("id", F.coalesce("id_own", "id_file").alias("item_id"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.coalesce("at_own", "at_file").alias("created_at")).where(F.col("item_id").isNotNull())


def fill_where_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Null columns of ``rows`` filled from the one row (the smallest) of ``known`` with their key."""
    cols = [c for c in known.columns if c != key]
    one = known.groupBy(key).agg(F.min(F.struct(*cols)).alias("_k"))
    return rows.join(one, key, "left").select(*[F.coalesce(F.col(c), F.col(f"_k.{c}")).alias(c) if c in cols else F.col(c) for c in rows.columns])


def cascade(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Every table without the rows that refer to the ids (a column ``id``)."""
    return {name: df.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*df.columns) for name, (df, column) in tables.items()}


def of_dimension(vectors: DataFrame, embedding: str, dim: int) -> DataFrame:
    """Rows of a vector table after a change of dimension: vectors of another length are gone and their status is pending again."""
    fits = F.coalesce(F.size(embedding) == dim, F.lit(False))
    return vectors.withColumn("status", F.when(fits, F.col("status")).otherwise("pending")).withColumn(embedding, F.when(fits, F.col(embedding)))


def vector_of_json(text: Column) -> Column:
    """The vector of a JSON object of positions to values."""
    entries = F.transform(F.map_entries(F.from_json(text, "map<string,float>")), lambda e: F.struct(e["key"].try_cast("int").alias("at"), e["value"].alias("value")))
    return F.transform(F.array_sort(entries), lambda e: e["value"])


def valid_vector(v: Column, dims: tuple[int, ...] = (384, 768, 1024, 1536, 3072)) -> Column:
    """struct(finite, usual_dimension)."""
    return F.struct(F.coalesce(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)).alias("finite"), F.coalesce(F.size(v).isin(*dims), F.lit(False)).alias("usual_dimension"))


def prior_context(rows: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Per row the texts of the ``n`` completed rows of its key before it, oldest first (order: start, id)."""
    done = F.when(F.col("status") == "completed", F.col("text"))
    w = Window.partitionBy(key).orderBy("start", "id")
    # completed rows are numbered; a row's context is the last n numbers before it
    counted = rows.withColumn("_n", F.coalesce(F.sum(F.when(done.isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    given = counted.where(F.col("status") == "completed").where(F.col("text").isNotNull()).select(F.col(key).alias("_k"), (F.col("_n") + 1).alias("_i"), F.col("text").alias("_t"))
    wanted = counted.select(key, "id", "_n", F.explode_outer(F.when(F.col("_n") > 0, F.sequence(F.greatest(F.col("_n") - (n - 1), F.lit(1)), F.col("_n")))).alias("_i"))
    got = wanted.join(given.withColumnRenamed("_k", key), [key, "_i"], "left")
    return got.groupBy(key, "id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_i", "_t")))), lambda x: x["_t"]).alias("context"))


def ended_before(rows: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Per row the ids of the last ``n`` rows of its key (by start, then id) that ended before it starts.

    Ends and starts are put in one order of time; the n latest of what has ended are carried along, and no more. A row that
    starts at no known time has nothing before it, one that ends at none is before nothing.
    """
    ends = rows.where(F.col("end").isNotNull()).select(key, F.col("end").cast("double").alias("at"), F.lit(1).alias("kind"), "start", "id")
    starts = rows.select(key, F.col("start").cast("double").alias("at"), F.lit(0).alias("kind"), "start", "id")

    def step(state, values):
        """State: the n rows that ended, latest starts last. At equal times starts come first, since an end must lie strictly before."""
        at, kind, start, i = values
        state = state or []
        if kind == 0:
            return state, (i, [] if at is None else [e[2] for e in state])
        return sorted([*state, (start is not None, start, i)])[-n:], None

    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("before", T.ArrayType(kind))])
    return scans.fold(ends.unionByName(starts), key, ["at", "kind", "start", "id"], [], step, out, "ended")


def write_back(items: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """``items`` with the score of ``scored`` where it has one."""
    return items.join(scored.select(key, F.col("score").alias("_s")), key, "left").withColumn("score", F.coalesce("_s", "score")).drop("_s")


def player_rows(segments: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Segments with their enhanced caption (else their own) and a scene text of what the enhanced row holds."""
    out = segments.join(enhanced.select("id", F.col("caption").alias("_c"), "caption_elements", "caption_spatial", "caption_temporal"), "id", "left")
    return out.select("id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.coalesce("transcript", F.lit("")).alias("transcription"), F.coalesce(F.nullif("_c", F.lit("")), F.nullif("caption", F.lit("")), F.lit("")).alias("caption"), joined(" ", "caption_elements", "caption_spatial", "caption_temporal").alias("scene"))


def joined(between: str, *columns: str) -> Column:
    """The texts that are neither null nor empty, in order."""
    return F.array_join(F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNotNull() & (x != "")), between)


def keyframe_context(frames: DataFrame, key: str) -> DataFrame:
    """Per segment: spatial and temporal texts in order, and its distinct elements in order of first occurrence."""
    w = F.array_sort(F.collect_list(F.struct("position", "spatial", "temporal", "elements")))
    out = frames.groupBy(key).agg(w.alias("f"))
    said = lambda c: F.array_join(F.filter(F.transform("f", lambda x: x[c]), lambda x: x.isNotNull() & (x != "")), " | ")
    return out.select(key, said("spatial").alias("spatial"), said("temporal").alias("temporal"), F.array_distinct(F.flatten(F.transform("f", lambda x: F.coalesce(x["elements"], F.array().cast("array<string>"))))).alias("elements"))


def batch_quality(frames: DataFrame, key: str, transcription: str, scene: str) -> DataFrame:
    """Per batch: text length up to 500 for .4, mean confidence for .3, a scene text of over 50 letters .2, spatial and temporal context .1."""
    any_of = lambda c: F.max(F.coalesce(F.col(c), F.lit("")) != "")
    out = frames.groupBy(key).agg(F.max(F.length(F.coalesce(transcription, F.lit("")))).alias("n"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("c"), F.max(F.length(F.coalesce(scene, F.lit("")))).alias("s"), (any_of("spatial") & any_of("temporal")).alias("both"))
    return out.select(key, F.least(F.lit(1.0), F.least(F.col("n") / 500, F.lit(1.0)) * 0.4 + F.col("c") * 0.3 + F.when(F.col("s") > 50, 0.2).otherwise(0.0) + F.when(F.col("both"), 0.1).otherwise(0.0)).alias("score"))


def content_chars(*columns: str) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in columns])


def store_totals(pages: DataFrame) -> DataFrame:
    """Sum of the stores' totals and the greatest depth."""
    return pages.agg(F.sum("total").alias("total"), F.max("depth").alias("depth"))


def text_hash(text: Column) -> Column:
    """The 31-multiplier hash of the first 100 characters as a signed 32-bit number (characters of the basic plane)."""
    codes = F.transform(F.filter(F.split(F.substring(text, 1, 100), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)


def cache_name(path: Column) -> Column:
    """Base name without extension, and the first eight letters and digits of the path's base64."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(name, F.lit("_"), F.substring(F.regexp_replace(F.base64(path.cast("binary")), r"[/+=\r\n]", ""), 1, 8))


def snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), name)


def snake_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(snake(c)) for c in df.columns])


ELEMENTS = "struct<objects:array<string>,people:array<string>,colors:array<string>,lighting:string,time:string,setting:string,mood:string>"


def extracted_elements(text: Column) -> Column:
    """Elements from a JSON object or, where it is none, from ``PREFIX: a, b`` lines; 'unknown' where something must stand."""
    j = F.from_json(text, ELEMENTS)
    is_json = F.json_object_keys(text).isNotNull()
    unknown = F.array(F.lit("unknown"))

    def line(prefix: str) -> Column:
        raw = F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{prefix}:[ \t]*(.*)$", 1))
        return F.trim(F.regexp_replace(raw, r"^\[|\]$", ""))

    def several(prefix: str, none: bool = False) -> Column:
        parts = F.transform(F.split(line(prefix), ","), lambda s: F.trim(s))
        return F.filter(parts, lambda s: (s != "") & ((F.lower(s) != "none") if none else F.lit(True)))

    full = lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(unknown)
    word = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    either = lambda name, from_json, from_lines: F.when(is_json, from_json).otherwise(from_lines).alias(name)
    return F.struct(
        either("objects", full(j["objects"]), full(several("OBJECTS"))),
        either("people", F.coalesce(j["people"], F.array().cast("array<string>")), several("PEOPLE", True)),
        either("colors", full(j["colors"]), full(several("COLORS"))),
        *[either(c, word(j[c]), word(line(c.upper()))) for c in ("lighting", "time", "setting")],
        either("mood", F.nullif(j["mood"], F.lit("")), F.nullif(line("MOOD"), F.lit(""))),
    )
