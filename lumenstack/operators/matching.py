"""Finding the RAW of an exported picture: recall, veto, score, decide.

Recall is a chain of stages, each for pictures that the stages before left
empty: same stem key, else the start of a normalised stem; a camera's file name
(which ends the chain, found or not); nearest capture times; same camera; newest
of all. Each stage gives at most ``RECALL`` candidates a picture.

Scale: the newest ``RECALL`` RAWs of a key are chosen before the join, so a key
that many RAWs share adds no more pairs than one with that many. The prefix stage
joins on every prefix of a RAW's stem that a picture asks for, instead of comparing
all pairs. The nearest-time stage joins blocks of places in the order of time.
Recalled pairs carry both rows, so scoring shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scores
from ..sources.scratch import staged
from .generic import top_per_group

RECALL = 200
AUTO, MANUAL = 0.90, 0.70
VETO_SECONDS = 6 * 3600


def keyed(files: DataFrame, stem: str = "stem") -> DataFrame:
    """Adds stem_key, alnum_key, camera_token and normalized_stem."""
    c = F.col(stem)
    return files.withColumns({"stem_key": names.stem_key(c), "alnum_key": names.stem_alnum_key(c), "camera_token": names.camera_token(c), "normalized_stem": names.normalize_stem(c)})


def _newest(r: str = "r") -> list[Column]:
    return [F.col(f"{r}.cached_at").desc_nulls_last(), F.col("raw_id").asc()]


def recall(images: DataFrame, raws: DataFrame, k: int = RECALL) -> DataFrame:
    """image_id, raw_id, the stage that found the pair, nth (its place in the
    stage's order), and both rows whole (i, r). ``images`` and ``raws`` are
    ``prepared``; a RAW's cached_at tells how new it is (without it, smaller ids
    come first). How new a RAW is doesn't depend on the picture, so the newest
    ``k`` of a key are chosen before any picture meets them. Which stage serves a
    picture follows from the keys alone; stages without pictures aren't planned."""
    if "cached_at" not in raws.columns:
        raws = raws.withColumn("cached_at", F.lit(None).cast("timestamp"))
    r = raws.select("raw_id", "stem_key", "normalized_stem", "capture_time", "camera_model", F.struct(*raws.columns).alias("r"))
    routed = staged(_route(images, r), "routed")
    used = {x[0] for x in routed.select("stage").distinct().collect()}  # six values at most
    of = lambda stage: routed.filter(F.col("stage") == stage).drop("stage")

    def newest(rows: DataFrame, key: str) -> DataFrame:
        return top_per_group(rows, [key], _newest(), k, "nth").select(key, "raw_id", "nth", "r")

    found = []
    if SAME_KEY in used:
        found.append((1, of(SAME_KEY).join(newest(r, "stem_key"), "stem_key")))
    if PREFIX in used:
        found.append((2, of(PREFIX).join(newest(_prefixes(r, of(PREFIX)), "stem_key"), "stem_key")))
    if OWN_TIMES in used:
        found.append((3, _within_reach(of(OWN_TIMES), r.filter("capture_time is not null and camera_model is not null"), k, ["camera_model"])))
    if ALL_TIMES in used:
        found.append((3, _within_reach(of(ALL_TIMES), r.filter("capture_time is not null"), k, [])))
    if SAME_CAMERA in used:
        found.append((4, of(SAME_CAMERA).join(newest(r, "camera_model"), "camera_model")))
    if NEWEST in used:
        last = r.orderBy(*_newest()).limit(k).withColumn("nth", F.row_number().over(Window.orderBy(*_newest()))).select("raw_id", "nth", "r")
        found.append((5, of(NEWEST).crossJoin(F.broadcast(last))))  # k rows
    if not found:
        found.append((0, of(0).join(newest(r.filter("false"), "stem_key"), "stem_key")))
    out = None
    for stage, rows in found:
        rows = rows.select("image_id", "raw_id", F.lit(stage).alias("stage"), "nth", "i", "r")
        out = rows if out is None else out.unionByName(rows)
    return out


SAME_KEY, PREFIX, ENDS, OWN_TIMES, ALL_TIMES, SAME_CAMERA, NEWEST = range(1, 8)


def _prefixes(r: DataFrame, wanted: DataFrame) -> DataFrame:
    """RAWs by those beginnings of their normalised stems that a picture asks for."""
    every = F.transform(F.sequence(F.lit(0), F.length("normalized_stem")), lambda n: F.substring(F.col("normalized_stem"), F.lit(1), n))
    return r.select("raw_id", "r", F.explode(every).alias("stem_key")).join(wanted.select("stem_key").distinct(), "stem_key", "left_semi")


def _route(images: DataFrame, r: DataFrame) -> DataFrame:
    """The stage that serves each picture, from the RAWs' distinct keys."""
    i = images.select("image_id", "stem_key", "camera_token", "capture_time", "camera_model", F.struct(*images.columns).alias("i"))
    flag = lambda rows, key, name: rows.select(key).distinct().withColumn(name, F.lit(True))
    keys = flag(r, "stem_key", "has_key")
    open_ = i.select("stem_key").join(keys, "stem_key", "left_anti")
    begun = flag(_prefixes(r.select("raw_id", F.lit(0).alias("r"), "normalized_stem"), open_), "stem_key", "has_prefix")
    cameras = r.filter("camera_model is not null").groupBy("camera_model").agg(F.lit(True).alias("has_camera"), F.bool_or(F.col("capture_time").isNotNull()).alias("has_times"))
    any_timed = F.broadcast(r.agg(F.coalesce(F.bool_or(F.col("capture_time").isNotNull()), F.lit(False)).alias("any_timed")))  # a row
    rows = i.join(keys, "stem_key", "left").join(begun, "stem_key", "left").join(cameras, "camera_model", "left").crossJoin(any_timed)
    timed = F.col("capture_time").isNotNull() & F.col("any_timed")
    stage = F.when(F.col("has_key"), SAME_KEY).when(F.col("has_prefix"), PREFIX).when(F.col("camera_token").isNotNull(), ENDS)
    stage = stage.when(timed & F.col("has_times"), OWN_TIMES).when(timed, ALL_TIMES).when(F.col("has_camera"), SAME_CAMERA).otherwise(NEWEST)
    return rows.select(*i.columns, stage.alias("stage"))


def nearest_times(images: DataFrame, raws: DataFrame, k: int) -> DataFrame:
    """The k RAWs (raw_id, r_time, r_camera) nearest in time to each picture:
    those of its own camera first, each kind by distance and id."""
    i = images.select("image_id", "capture_time", "camera_model")
    r = raws.select("raw_id", F.col("r_time").alias("capture_time"), F.col("r_camera").alias("camera_model"), F.struct(F.lit(None).cast("timestamp").alias("cached_at"), "r_camera").alias("r"))
    own = _within_reach(i.filter("camera_model is not null"), r.filter("camera_model is not null"), k, ["camera_model"]).select("image_id", "raw_id", "micros_apart", F.lit(0).alias("other"))
    every = _within_reach(i, r, k, []).select("image_id", "raw_id", "micros_apart", F.when(F.col("camera_model") == F.col("r.r_camera"), 0).otherwise(1).alias("other"))
    pairs = own.unionByName(every).distinct()
    return top_per_group(pairs, ["image_id"], [F.col("other"), F.col("micros_apart"), F.col("raw_id")], k, "__n").select("image_id", "raw_id", "micros_apart")


def _within_reach(images: DataFrame, raws: DataFrame, k: int, by: list[str]) -> DataFrame:
    """``images`` with their k nearest RAWs in time (of equal ``by``): raw_id, r,
    micros_apart, nth. ``raws``: raw_id, capture_time, r, ``by``.

    Every RAW gets its place in the order of time, every distinct time of a
    picture the number of RAWs before it. The k nearest are within k places to
    either side, so blocks of k places are joined: a time meets four blocks at
    most, however many RAWs a day has. Places come from counts by day and
    minute; of RAWs of one instant only the k first can matter. Ties of distance go to
    the newer RAW, then the smaller id, on both sides, so the earlier side has an order
    of its own (``back``)."""
    micros, minute, day = F.unix_micros("capture_time"), F.floor(F.unix_seconds("capture_time") / 60), F.floor(F.unix_seconds("capture_time") / 86_400)
    r = top_per_group(raws.withColumn("at", micros), [*by, "at"], _newest(), k, "tie").withColumns({"minute": minute, "day": day})
    points = images.select(*by, "capture_time").distinct().withColumns({"at": micros, "minute": minute, "day": day})

    counts = r.groupBy(*by, "day", "minute").agg(F.count("*").alias("n")).unionByName(points.select(*by, "day", "minute").distinct().withColumn("n", F.lit(0).cast("long")))
    minutes = counts.groupBy(*by, "day", "minute").agg(F.sum("n").alias("n"))
    until = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = minutes.groupBy(*by, "day").agg(F.sum("n").alias("n"))
    days = days.withColumn("day_base", until(Window.partitionBy(*by).orderBy("day"))).drop("n")  # a row a day
    base = minutes.withColumn("minute_base", until(Window.partitionBy(*by, "day").orderBy("minute"))).join(days, [*by, "day"]).select(*by, "minute", (F.col("day_base") + F.col("minute_base")).alias("base"))

    # RAWs and times of one minute in one order; a time comes before RAWs of the same instant
    one = r.select(*by, "minute", "at", "tie", "raw_id", "r", F.lit(1).alias("is_raw")).unionByName(points.select(*by, "minute", "at", F.lit(0).alias("is_raw")), allowMissingColumns=True)
    w = Window.partitionBy(*by, "minute")
    seen = lambda order: F.sum("is_raw").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = one.withColumns({"fore": seen(["at", "is_raw", "tie"]), "back": seen(["at", "is_raw", F.desc("tie")])}).join(base, [*by, "minute"])
    one = one.select(*by, "at", "raw_id", "r", "tie", "is_raw", (F.col("base") + F.col("fore") - F.col("is_raw")).alias("fore"), (F.col("base") + F.col("back") - F.col("is_raw")).alias("back"))

    placed = one.filter("is_raw = 1").select(*by, F.col("at").alias("r_at"), "raw_id", "r", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("place")) for s, c in ((0, "back"), (1, "fore"))))))
    placed = placed.withColumn("part", F.floor(F.col("place") / k))
    sides = [F.struct(F.lit(0).alias("side"), (F.col("fore") - k).alias("lo")), F.struct(F.lit(1).alias("side"), F.col("fore").alias("lo"))]
    wanted = one.filter("is_raw = 0").select(*by, "at", F.inline(F.array(*sides)))
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / k), F.floor((F.col("lo") + k - 1) / k))))
    near = wanted.join(placed, [*by, "side", "part"]).filter((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + k))
    near = near.withColumn("micros_apart", F.abs(F.col("at") - F.col("r_at")))
    near = top_per_group(near, [*by, "at"], [F.col("micros_apart"), *_newest()], k, "nth").select(*by, "at", "raw_id", "r", "micros_apart", "nth")
    return images.withColumn("at", micros).join(near, [*by, "at"]).drop("at")


def paired(images: DataFrame, raws: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the columns of both sides, as i_* and r_*. Pairs of
    ``recall`` carry them; others are joined by their ids."""
    if {"i", "r"} <= set(pairs.columns):
        side = lambda n, df, key: [F.col(f"{n}.{c}").alias(f"{n}_{c}") for c in df.columns if c != key]
        return pairs.select(*(c for c in pairs.columns if c not in ("i", "r")), *side("i", images, "image_id"), *side("r", raws, "raw_id"))
    i = images.select(*(F.col(c).alias("image_id" if c == "image_id" else f"i_{c}") for c in images.columns))
    r = raws.select(*(F.col(c).alias("raw_id" if c == "raw_id" else f"r_{c}") for c in raws.columns))
    return pairs.join(i, "image_id").join(r, "raw_id")


def features() -> dict[str, Column]:
    """The features of a ``paired`` row, by name."""
    i, r = (lambda c: F.col(f"i_{c}")), (lambda c: F.col(f"r_{c}"))
    return {
        "exact_stem_key": F.coalesce((i("stem_key") == r("stem_key")).cast("double"), F.lit(0.0)),
        "alnum_stem_key": scores.equal_score(i("alnum_key"), r("alnum_key")),
        "stem_similarity": F.coalesce(F.col("similarity"), F.lit(0.0)),
        "capture_time": scores.timestamp_score(i("capture_time"), r("capture_time")),
        "camera_model": scores.same_text_score(i("camera_model"), r("camera_model")),
        "lens_model": scores.same_text_score(i("lens_model"), r("lens_model")),
        "aspect_ratio": scores.aspect_score(i("aspect_ratio"), r("aspect_ratio")),
    }


def vetoes() -> Column:
    """Why a pair can't be: names apart, other camera, hours apart."""
    f = features()
    family = (F.col("i_stem_key") != "") & (F.col("r_stem_key") != "") & (F.col("similarity") < 0.35) & (f["exact_stem_key"] == 0) & (f["alnum_stem_key"] == 0)
    camera = (F.col("i_camera_model") != "") & (F.col("r_camera_model") != "") & (F.lower("i_camera_model") != F.lower("r_camera_model"))
    late = scores.seconds_apart(F.col("i_capture_time"), F.col("r_capture_time")) > VETO_SECONDS
    return F.array_compact(F.array(F.when(family, "filename_family_conflict"), F.when(camera, "camera_model_conflict"), F.when(late, "capture_time_window_exceeded")))


def scored(images: DataFrame, raws: DataFrame, pairs: DataFrame) -> DataFrame:
    """image_id, raw_id, nth, score and features of the pairs without a veto.
    Similarity is computed once, on recalled pairs only."""
    rows = paired(images, raws, pairs).withColumn("similarity", scores.stem_similarity(F.col("i_stem_key"), F.col("r_stem_key")))
    f = features()
    shown = F.create_map(*(x for name, c in f.items() for x in (F.lit(name), c)))
    nth = F.col("nth") if "nth" in rows.columns else F.lit(0)
    return rows.filter(F.size(vetoes()) == 0).select("image_id", "raw_id", nth.alias("nth"), scores.weighted(f).alias("score"), shown.alias("features"))


def _status(score: Column, auto: float, manual: float) -> Column:
    return F.when(score >= auto, "auto_bound").when(score >= manual, "pending_confirmation").otherwise("unmatched")


def decide(images: DataFrame, candidates: DataFrame, auto: float = AUTO, manual: float = MANUAL) -> DataFrame:
    """A decision for each picture: status, raw_id (null if unmatched), score,
    and its five best candidates; of equal scores the one recalled first."""
    top = top_per_group(candidates, ["image_id"], [F.desc("score"), F.col("nth").asc(), F.col("raw_id").asc()], 5)
    best = top.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "raw_id", "score", "features")), lambda a, b: a["rank"] - b["rank"]).alias("candidates"))
    out = images.select("image_id").join(best, "image_id", "left").withColumn("score", F.coalesce(F.col("candidates")[0]["score"], F.lit(0.0)))
    out = out.withColumn("status", _status(F.col("score"), auto, manual))
    return out.select("image_id", "status", F.when(F.col("status") != "unmatched", F.col("candidates")[0]["raw_id"]).alias("raw_id"), "score", F.coalesce("candidates", F.array().cast(out.schema["candidates"].dataType)).alias("candidates"))


def decided_status(images: DataFrame, candidates: DataFrame, auto: float = AUTO, manual: float = MANUAL) -> DataFrame:
    """image_id and status alone: what counts need, without lists of candidates."""
    best = candidates.groupBy("image_id").agg(F.max("score").alias("score"))
    return images.select("image_id").join(best, "image_id", "left").select("image_id", _status(F.coalesce("score", F.lit(0.0)), auto, manual).alias("status"))


def prepared(images: DataFrame, raws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their keys, staged: each of the recall stages reads them."""
    return staged(keyed(images), "pictures"), staged(keyed(raws), "raws")


def resolve(images: DataFrame, raws: DataFrame, previous: DataFrame | None = None, refresh: bool = False, auto: float = AUTO, manual: float = MANUAL) -> DataFrame:
    """Decisions for all pictures. ``previous`` decisions stand where a person
    confirmed them, and where they were bound automatically unless ``refresh``."""
    images, raws = prepared(images, raws)
    if previous is None:
        return decide(images, scored(images, raws, recall(images, raws)), auto, manual)
    sticky = previous.filter(F.col("status") == "manual_confirmed") if refresh else previous.filter(F.col("status").isin("manual_confirmed", "auto_bound"))
    sticky = sticky.join(images.select("image_id"), "image_id", "left_semi")
    rest = images.join(sticky.select("image_id"), "image_id", "left_anti")
    new = decide(rest, scored(rest, raws, recall(rest, raws)), auto, manual)
    return new.unionByName(sticky.select("image_id", "status", "raw_id", "score"), allowMissingColumns=True)


def confirm(registry: DataFrame, image: str, raw: str) -> DataFrame:
    """A person's decision; the link's confidence is at least the manual threshold."""
    own = F.col("image_id") == image
    return registry.withColumns({"raw_id": F.when(own, raw).otherwise(F.col("raw_id")), "status": F.when(own, "manual_confirmed").otherwise(F.col("status")), "score": F.when(own, F.greatest("score", F.lit(MANUAL))).otherwise(F.col("score"))})


def status_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(F.count("*").alias("count"))


def batch_counts(decisions: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: newly bound, already bound, still open, all."""
    before = previous.select("image_id", F.col("status").isin("auto_bound", "manual_confirmed").alias("was"))
    bound = F.col("status").isin("auto_bound", "manual_confirmed")
    rows = decisions.join(before, "image_id", "left").withColumn("was", F.coalesce("was", F.lit(False)))
    return rows.agg(F.count_if(bound & ~F.col("was")).alias("newly_bound"), F.count_if(bound & F.col("was")).alias("already_bound"), F.count_if(~bound).alias("open"), F.count("*").alias("total"))
