"""People groups over faces: listing, corrections, merging. A correction is
computed for all its rows before anything is written, so a batch is one whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .generic import largest_per_group, require_all, update_where, upsert

Tables = dict[str, DataFrame]
STATES = ("candidate", "confirmed", "ignored")


def active(members: DataFrame) -> DataFrame:
    return members.filter(F.col("membership_state") != "rejected")


def covers(tables: Tables) -> DataFrame:
    """group_id and its most confident active face (then the smallest id)."""
    rows = active(tables["person_group_faces"]).join(tables["asset_faces"].select("face_id", "confidence"), "face_id")
    best = rows.groupBy("group_id").agg(F.max("confidence").alias("confidence"))
    return rows.join(best, ["group_id", "confidence"]).groupBy("group_id").agg(F.min("face_id").alias("best_face"))


def list_groups(tables: Tables, state: str | None = None) -> DataFrame:
    """Groups with faces or a name: named ones first, then by faces, age, id."""
    groups = tables["person_groups"] if state is None else tables["person_groups"].filter(F.col("state") == state)
    counts = active(tables["person_group_faces"]).groupBy("group_id").agg(F.count_distinct("face_id").alias("face_count"))
    rows = groups.join(counts, "group_id", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0))).filter((F.col("face_count") > 0) | F.col("name").isNotNull())
    rows = rows.join(covers(tables), "group_id", "left").withColumn("cover_face_id", F.coalesce("cover_face_id", "best_face")).drop("best_face")
    shown = rows.join(tables["asset_faces"].select(F.col("face_id").alias("cover_face_id"), F.col("asset_id").alias("cover_asset_id")), "cover_face_id", "left")
    return shown.orderBy(F.col("name").isNull(), F.desc("face_count"), F.col("created_at").asc_nulls_first(), "group_id")


def wall_order(groups: DataFrame, least: int = 3, search: str | None = None) -> DataFrame:
    """For the wall: small groups without a name go last; ``search`` in names."""
    rows = groups.filter(F.lower("name").contains(search.lower())) if search else groups
    return rows.orderBy(F.col("name").isNull() & (F.col("face_count") < least), F.col("name").isNull(), F.desc("face_count"), "group_id")


def group_detail(tables: Tables, group_id: str, limit: int = 40, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The group with faces and photos counted; a page of its faces."""
    rows = active(tables["person_group_faces"]).filter(F.col("group_id") == group_id).join(tables["asset_faces"], "face_id")
    head = tables["person_groups"].filter(F.col("group_id") == group_id).join(rows.groupBy("group_id").agg(F.count("*").alias("face_count"), F.count_distinct("asset_id").alias("photo_count")), "group_id", "left")
    return head, rows.orderBy(F.desc("confidence"), "face_id").offset(offset).limit(limit)


def people_in(tables: Tables, asset_id: str) -> DataFrame:
    """The faces of a picture, with their group if they are in one."""
    faces = tables["asset_faces"].filter(F.col("asset_id") == asset_id)
    members = active(tables["person_group_faces"]).select("face_id", "group_id")
    return faces.join(members, "face_id", "left").join(tables["person_groups"].select("group_id", "name", "state"), "group_id", "left").orderBy("face_id")


def unassigned(tables: Tables, model_id: str, model_version: str) -> DataFrame:
    """Faces of one space in no group; a rejected membership counts as one, so
    that a correction is never undone."""
    space = tables["asset_faces"].filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version))
    return space.join(tables["person_group_faces"].select("face_id"), "face_id", "left_anti")


def index_candidates(tables: Tables, model_id: str, model_version: str, limit: int | None = None) -> DataFrame:
    """Pictures on disk with their index row of this model."""
    own = tables["people_asset_index"].filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version)).select("asset_id", "status", "input_hash", "file_size", "file_mtime")
    rows = tables["assets"].filter((F.col("asset_type") == "image") & F.col("exists_on_disk")).select("asset_id", "path").join(own, "asset_id", "left").orderBy("path", "asset_id")
    return rows.limit(limit) if limit is not None else rows


def replace_faces(tables: Tables, asset_id: str, model_id: str, model_version: str, faces: DataFrame) -> Tables:
    """The faces of one picture and model become ``faces``; memberships of those
    that go end, and candidate groups without members go."""
    own = (F.col("asset_id") == asset_id) & (F.col("model_id") == model_id) & (F.col("model_version") == model_version)
    old = tables["asset_faces"]
    gone = old.filter(own).select("face_id").join(faces.select("face_id"), "face_id", "left_anti")
    return tidy(tables | {"asset_faces": old.filter(~own).unionByName(faces.select(*old.columns)), "person_group_faces": tables["person_group_faces"].join(gone, "face_id", "left_anti")})


def tidy(tables: Tables) -> Tables:
    """Covers that are no active member are cleared; candidate groups without
    a name and without any membership go. Rejected memberships keep theirs."""
    members = tables["person_group_faces"]
    held = active(members).select("group_id", F.col("face_id").alias("cover_face_id"), F.lit(True).alias("held"))
    groups = tables["person_groups"].join(held, ["group_id", "cover_face_id"], "left")
    groups = groups.withColumn("cover_face_id", F.when(F.col("held"), F.col("cover_face_id"))).select(*tables["person_groups"].columns)
    some = members.select("group_id").distinct().withColumn("some", F.lit(True))
    kept = groups.join(some, "group_id", "left").filter(F.col("some") | (F.col("state") != "candidate") | F.col("name").isNotNull()).select(*groups.columns)
    return tables | {"person_groups": kept}


def clear_candidates(tables: Tables) -> Tables:
    """Before clusters are rebuilt: memberships of unnamed candidate groups end,
    but for rejected ones, and groups left without any go."""
    open_ = tables["person_groups"].filter((F.col("state") == "candidate") & F.col("name").isNull()).select("group_id", F.lit(True).alias("open"))
    members = tables["person_group_faces"].join(open_, "group_id", "left").filter(F.col("open").isNull() | (F.col("membership_state") == "rejected")).select(*tables["person_group_faces"].columns)
    return tidy(tables | {"person_group_faces": members})


def add_groups(tables: Tables, groups: DataFrame) -> Tables:
    """Writes ``vectors.candidate_groups`` as candidate groups."""
    heads = groups.filter("is_cover").select("group_id", F.lit("candidate").alias("state"), F.col("face_id").alias("cover_face_id"))
    members = groups.select("group_id", "face_id", F.lit("candidate").alias("membership_state"), F.lit("auto").alias("source"))
    return tables | {"person_groups": tables["person_groups"].unionByName(heads, allowMissingColumns=True), "person_group_faces": tables["person_group_faces"].unionByName(members, allowMissingColumns=True)}


def rename(groups: DataFrame, group_id: str, name: str) -> DataFrame:
    if not name.strip():
        raise ValueError("a name is needed")
    return update_where(groups, F.col("group_id") == group_id, name=F.lit(name.strip()), state=F.lit("confirmed"))


def set_cover(tables: Tables, group_id: str, face_id: str) -> DataFrame:
    own = active(tables["person_group_faces"]).filter((F.col("group_id") == group_id) & (F.col("face_id") == face_id))
    if own.isEmpty():
        raise ValueError("the cover must be a member")
    return update_where(tables["person_groups"], F.col("group_id") == group_id, cover_face_id=F.lit(face_id))


def set_states(groups: DataFrame, wanted: DataFrame, state: str) -> DataFrame:
    """Sets the state of all group_ids of ``wanted``, or, if one isn't there, none."""
    if state not in STATES:
        raise ValueError(f"no such state: {state}")
    require_all(wanted, groups, "group_id")
    marked = groups.join(wanted.select("group_id").distinct().withColumn("hit", F.lit(True)), "group_id", "left")
    return marked.withColumn("state", F.when(F.col("hit"), state).otherwise(F.col("state"))).select(*groups.columns)


def remove_faces(tables: Tables, faces: DataFrame) -> Tables:
    """Marks memberships of all face_ids as rejected by the user; all or none."""
    members = tables["person_group_faces"]
    require_all(faces, active(members), "face_id")
    marked = members.join(faces.select("face_id").distinct().withColumn("hit", F.lit(True)), "face_id", "left")
    out = marked.withColumns({"membership_state": F.when(F.col("hit"), "rejected").otherwise(F.col("membership_state")), "source": F.when(F.col("hit"), "user_split").otherwise(F.col("source"))}).select(*members.columns)
    return tidy(tables | {"person_group_faces": out})


def assign_faces(tables: Tables, faces: DataFrame, group_id: str) -> Tables:
    """Moves or adds all face_ids to a group as confirmed; all or none, and
    only faces of the space of the group's members."""
    require_all(faces, tables["asset_faces"], "face_id")
    known = tables["asset_faces"].select("face_id", "model_id", "model_version")
    inside = active(tables["person_group_faces"]).filter(F.col("group_id") == group_id).join(known, "face_id").select("model_id", "model_version")
    spaces = inside.unionByName(faces.select("face_id").join(known, "face_id").select("model_id", "model_version")).distinct()
    if spaces.limit(2).count() > 1:
        raise ValueError("faces of other models can't join the group")
    new = faces.select("face_id").distinct().select(F.lit(group_id).alias("group_id"), "face_id", F.lit("confirmed").alias("membership_state"), F.lit("user").alias("source"))
    members = tables["person_group_faces"]
    out = members.join(new.select("face_id"), "face_id", "left_anti").select(*members.columns).unionByName(new, allowMissingColumns=True)
    return tidy(tables | {"person_group_faces": out})


def merge_groups(tables: Tables, source: str, target: str) -> Tables:
    """Members of ``source`` join ``target``, marked as merged; ``source`` goes."""
    if source == target:
        raise ValueError("a group can't be merged with itself")
    own = F.col("group_id") == source
    members = update_where(tables["person_group_faces"], own, source=F.lit("user_merged"), group_id=F.lit(target))
    return tidy(tables | {"person_groups": tables["person_groups"].filter(~own), "person_group_faces": members})


def save_index(index: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(index, rows, ["asset_id", "model_id", "model_version"])


def save_model(models: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(models, rows, ["model_id", "model_version"])


def latest_index(index: DataFrame) -> DataFrame:
    return largest_per_group(index, ["asset_id"], [F.col("updated_at"), F.col("model_version")])
