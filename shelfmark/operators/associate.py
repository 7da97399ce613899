"""Files grouped into items: bundles of applications, single items, and one item for each content file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import classify as c
from shelfmark.functions.paths import ancestor_dirs, match_key, name_of, parent_dir, stem
from shelfmark.operators.scratch import stored


def real_files(files: DataFrame) -> DataFrame:
    """files (file_id, path, size, mime) but for containers: rows without a size, paths that others lie in,
    and archives that are the parent_id of others, where files has that column."""
    dirs = files.select(parent_dir(F.col("path")).alias("path")).distinct()
    out = files.where("size is not null").join(dirs, "path", "left_anti")
    if "parent_id" not in files.columns:
        return out
    return out.join(files.where("parent_id is not null").select(F.col("parent_id").alias("file_id")).distinct(), "file_id", "left_anti").drop("parent_id")


def classified(files: DataFrame) -> DataFrame:
    name, mime = F.col("name"), F.col("mime")
    named = files.withColumns({"folder": parent_dir(F.col("path")), "name": name_of(F.col("path"))})
    return named.withColumns({"kind": c.sidecar_kind(name, mime), "primary_media": c.is_primary_media(name, mime), "exe": c.is_executable(name), "aux": c.is_auxiliary_executable(name)})


def bundle_roots(own: DataFrame) -> DataFrame:
    """(root): outermost folders that hold an executable and a resource; they own all below."""
    apps = own.groupBy("folder").agg(F.bool_or((F.col("kind") == "Content") & F.col("exe")).alias("has_exe"), F.bool_or(F.col("kind") == "CompanionResource").alias("has_resource")).where("has_exe and has_resource").select("folder")
    above = apps.select("folder", F.explode(ancestor_dirs(F.col("folder"))).alias("up"))
    inner = above.join(apps.select(F.col("folder").alias("up")), "up", "left_semi").select("folder")
    return apps.join(inner, "folder", "left_anti").withColumnRenamed("folder", "root")


def _bundles(own: DataFrame) -> DataFrame:
    """own has root. The executable named like the folder, else the largest that is no helper, is primary."""
    base = match_key(F.regexp_replace("name", r"\.[^./\\]*$", ""))
    key = match_key(name_of(F.col("root")))
    named = (base != "") & (key != "") & (F.contains(key, base) | F.contains(base, key))
    at_root = (F.col("folder") == F.col("root")) & (F.col("kind") == "Content") & F.col("exe")
    grade = F.when(at_root & named, 3).when(at_root & ~F.col("aux"), 2).when(at_root, 1).when(F.col("kind") == "Content", 0)
    best = own.withColumn("grade", grade).where("grade is not null").groupBy("root").agg(
        F.min_by(F.col("file_id"), F.struct(-F.col("grade"), F.when(F.col("grade") == 0, 0).when(F.col("grade") == 3, 0).otherwise(-F.coalesce("size", F.lit(0))), F.col("name"), F.col("path"))).alias("primary_id")
    )
    sidecar = F.col("kind").isin("Opf", "Nfo", "Lrc")
    role = F.when(F.col("file_id") == F.col("primary_id"), "Primary").when(sidecar, "Sidecar").otherwise("Companion")
    return own.join(best, "root").select("file_id", "path", "folder", "kind", role.alias("role"), F.col("primary_id").alias("item_id"))


def _folders(own: DataFrame) -> DataFrame:
    content = F.col("kind") == "Content"
    per = own.groupBy("folder").agg(F.bool_or(content & F.col("primary_media")).alias("media"))
    marked = own.join(per, "folder").withColumn("real", content & (~F.col("media") | F.col("primary_media")))
    count = marked.where("real").groupBy("folder").agg(F.count("*").alias("n_real"), F.min("file_id").alias("only_id"))
    marked = marked.join(count, "folder", "left").fillna({"n_real": 0})
    # A track's lyrics are told by an equal name; of several the first path counts.
    tracks = marked.where("real and n_real > 1").groupBy("folder", stem(F.col("name")).alias("stem")).agg(F.min_by("file_id", "path").alias("track_id"))
    lyrics = marked.withColumn("stem", F.when(F.col("kind") == "Lrc", stem(F.col("name")))).join(tracks, ["folder", "stem"], "left")
    single = F.col("n_real") == 1
    sidecar = F.col("kind").isin("Opf", "Nfo", "Lrc")
    role = F.when(F.col("real"), "Primary").when(sidecar, "Sidecar").otherwise("Companion")
    item = F.when(single, F.col("only_id")).when(F.col("real"), F.col("file_id")).otherwise(F.col("track_id"))
    return lyrics.select("file_id", "path", "folder", "kind", role.alias("role"), item.alias("item_id"))


def associate(files: DataFrame) -> DataFrame:
    """(file_id, path, folder, kind, role, item_id); an item bears the id of its primary file.

    Every step groups or joins by folder or root; a folder's ancestors are
    exploded, so finding the root that owns it is an equi-join. The classified
    files are written once, as all steps read them.
    """
    own = stored(classified(real_files(files)), "classified")
    roots = bundle_roots(own)
    up = own.select("folder").distinct().select("folder", F.explode(F.concat(F.array("folder"), ancestor_dirs(F.col("folder")))).alias("root"))
    owned = up.join(roots, "root", "left_semi").groupBy("folder").agg(F.max_by("root", F.length("root")).alias("root"))
    placed = own.join(owned, "folder", "left")
    return _bundles(placed.where("root is not null")).unionByName(_folders(placed.where("root is null").drop("root")))


#: Written by, tag, description, publisher and language; date released.
PROMOTED_TEXTS, PROMOTED_DATES = (76, 72, 46, 59, 54), (45,)


def promotions(associated: DataFrame, contents: DataFrame, attributes: DataFrame) -> DataFrame:
    """(file_id, definition, value_text, value_date): what sidecars give to the primary file of their item.

    attributes is (file_id, definition, value_text, value_date). Lyrics and
    comments are the content of .lrc and .nfo files, without blanks around it: given once, by the first
    path, and not where the file has one already. Of the attributes of .opf files
    a text is given where the file does not have the same one, and a date, of the
    first path, where it has none.
    """
    given = associated.where("role = 'Sidecar' and item_id is not null")
    contents = contents.select("file_id", F.regexp_replace("content", r"(?U)^\s+|\s+$", "").alias("content"))
    definition = F.when(F.col("kind") == "Lrc", 15).when(F.col("kind") == "Nfo", 38)
    text = given.withColumn("definition", definition).where("definition is not null").join(contents, "file_id").where("content <> ''")
    first = text.groupBy(F.col("item_id").alias("file_id"), "definition").agg(F.min_by("content", "path").alias("value_text"))
    whole = first.join(attributes.select("file_id", "definition").distinct(), ["file_id", "definition"], "left_anti")

    own = given.where("kind = 'Opf'").select("file_id", "item_id", "path").join(attributes, "file_id").drop("file_id").withColumnRenamed("item_id", "file_id")
    texts = own.where(F.col("definition").isin(*PROMOTED_TEXTS) & F.col("value_text").isNotNull()).select("file_id", "definition", "value_text").distinct()
    texts = texts.join(attributes.select("file_id", "definition", "value_text"), ["file_id", "definition", "value_text"], "left_anti")
    dates = own.where(F.col("definition").isin(*PROMOTED_DATES) & F.col("value_date").isNotNull())
    dates = dates.groupBy("file_id", "definition").agg(F.min_by("value_date", F.struct("path", "value_date")).alias("value_date"))
    dates = dates.join(attributes.select("file_id", "definition").distinct(), ["file_id", "definition"], "left_anti")
    return whole.unionByName(texts).unionByName(dates, allowMissingColumns=True)


def counters(associated: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """(items, sidecars, companions[, promotions]) of associate() and promotions()."""
    found = associated.agg(F.count_distinct("item_id").alias("items"), F.count_if(F.col("role") == "Sidecar").alias("sidecars"), F.count_if(F.col("role") == "Companion").alias("companions"))
    return found if promoted is None else found.crossJoin(promoted.agg(F.count("*").alias("promotions")))
