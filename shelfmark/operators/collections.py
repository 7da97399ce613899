"""Collections: the fold of folders into nested collections, and browsing them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.classify import DISC_RIP_EXTENSIONS, folder_is_dedicated, is_season_name, is_structural_name
from shelfmark.functions.paths import ancestor_dirs, extension, name_of, parent_dir
from shelfmark.operators.scratch import stored

#: Hops up a chain of parents.
MAX_HOPS = 64
# Names of covers in order of preference.
COVERS = ["cover", "folder", "poster", "front", "albumart", "backdrop", "fanart", "thumb", "banner"]


def _folder_table(associated: DataFrame) -> DataFrame:
    """One row for each folder and ancestor of one: what it holds itself."""
    rip = extension(name_of(F.col("path"))).isin(*DISC_RIP_EXTENSIONS)
    primary = (F.col("role") == "Primary") & F.col("item_id").isNotNull()
    own = associated.where("folder <> ''").groupBy("folder").agg(
        F.count_if(primary).alias("n_items"), F.bool_or(rip).alias("rip"), F.min(F.when(primary, F.struct("path", name_of(F.col("path")).alias("name"))))["name"].alias("primary_name")
    )
    every = own.select("folder").unionByName(own.select(F.explode(ancestor_dirs(F.col("folder"))).alias("folder"))).where("folder <> ''").distinct()
    out = every.join(own, "folder", "left").fillna({"n_items": 0, "rip": False})
    return out.withColumns({"parent": parent_dir(F.col("folder")), "name": name_of(F.col("folder")), "depth": F.size(F.split("folder", "/"))})


def fold(associated: DataFrame) -> DataFrame:
    """(folder, parent, depth, is_collection, kind, n_bubbled) of every folder, bottom up.

    One level of depth at a time: a folder needs only sums over its children. Each
    level is written, so no plan holds those below it. kind is null where a folder is no collection; n_bubbled counts the items that a
    folder which is none hands to its parent. A structural folder that hands up
    items becomes a collection of its own below a collection.
    """
    table = stored(_folder_table(associated), "folders")
    deepest = table.agg(F.max("depth")).first()[0] or 0
    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        level = table.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"full_kids": F.lit(0).cast("long"), "structural_kid": F.lit(False), "season_kid": F.lit(False)})
        else:
            kids = below.groupBy(F.col("parent").alias("folder")).agg(
                F.count_if(F.col("is_collection") | (F.col("n_bubbled") > 0)).alias("full_kids"), F.bool_or(is_structural_name(F.col("name"))).alias("structural_kid"), F.bool_or(is_season_name(F.col("name"))).alias("season_kid")
            )
            level = level.join(kids, "folder", "left").fillna({"full_kids": 0, "structural_kid": False, "season_kid": False})
        rips = F.when(F.col("rip"), F.array(F.lit("rip.vob"))).otherwise(F.array().cast("array<string>"))
        dedicated = F.coalesce(folder_is_dedicated(F.col("name"), F.col("primary_name"), rips), F.lit(True))
        alone = (F.col("full_kids") == 0) & (F.col("n_items") == 1)
        is_collection = F.when(F.col("structural_kid"), True).when(alone, ~dedicated).otherwise(F.col("full_kids") + F.col("n_items") >= 1)
        below = level.withColumn("is_collection", is_collection).withColumn("n_bubbled", F.when(F.col("is_collection"), 0).otherwise(F.col("n_items"))).select("folder", "parent", "name", "depth", "season_kid", "is_collection", "n_bubbled")
        below = stored(below, "level")
        levels.append(below)
    if not levels:
        return associated.sparkSession.createDataFrame([], "folder string, parent string, depth int, is_collection boolean, kind string, n_bubbled long")
    every = reduce(DataFrame.unionByName, levels)
    above = every.select(F.col("folder").alias("parent"), F.col("is_collection").alias("parent_is"))
    structural = (F.col("n_bubbled") > 0) & is_structural_name(F.col("name")) & F.coalesce("parent_is", F.lit(False))
    kind = F.when(F.col("is_collection"), F.when(F.col("season_kid"), "Show").otherwise("Generic")).when(structural, F.when(is_season_name(F.col("name")), "Season").otherwise("Generic"))
    return every.join(above, "parent", "left").select("folder", "parent", "depth", (F.col("is_collection") | structural).alias("is_collection"), kind.alias("kind"), F.col("n_bubbled").cast("long").alias("n_bubbled"))


def owned_files(folded: DataFrame, associated: DataFrame) -> DataFrame:
    """(file_id, collection, role): the art and .nfo files that lie in the folder of a collection belong to it."""
    own = associated.where(F.col("kind").isin("CompanionArt", "Nfo")).select("file_id", F.col("folder").alias("collection"), F.when(F.col("kind") == "Nfo", "Sidecar").otherwise("Companion").alias("role"))
    return own.join(folded.where("is_collection").select(F.col("folder").alias("collection")), "collection", "left_semi").select("file_id", "collection", "role")


#: The definition of comments.
COMMENT = 38


def comments(folded: DataFrame, associated: DataFrame, contents: DataFrame, known: DataFrame) -> DataFrame:
    """(collection, definition, value): the text of a collection's .nfo file, without blanks around it, as its comment.

    Given once, by the first path that has text, where known (collection, definition) has none yet.
    """
    own = owned_files(folded, associated).where("role = 'Sidecar'").join(associated.select("file_id", "path"), "file_id")
    text = contents.select("file_id", F.regexp_replace("content", r"(?U)^\s+|\s+$", "").alias("value")).where("value <> ''")
    first = own.join(text, "file_id").groupBy("collection").agg(F.min_by("value", "path").alias("value"))
    return first.join(known.where(F.col("definition") == COMMENT).select("collection"), "collection", "left_anti").select("collection", F.lit(COMMENT).alias("definition"), "value")


def item_collections(folded: DataFrame, associated: DataFrame) -> DataFrame:
    """(item_id, collection): the folder that is the item's collection: its own, else the one above, which it is handed to."""
    items = associated.where("role = 'Primary' and item_id is not null and folder <> ''").select("item_id", "folder").distinct()
    own = folded.select("folder", "parent", F.col("is_collection").alias("own"))
    above = folded.where("is_collection").select(F.col("folder").alias("parent"), F.lit(True).alias("above"))
    placed = items.join(own, "folder").join(above, "parent", "left")
    return placed.select("item_id", F.when(F.col("own"), F.col("folder")).when(F.col("above"), F.col("parent")).alias("collection"))


def with_manual(folded: DataFrame, manual: DataFrame) -> DataFrame:
    """(folder, kind, source) of all collections: manual ones (folder, kind), and folded ones where none is pinned by hand."""
    auto = folded.where("is_collection").join(manual.select("folder"), "folder", "left_anti").select("folder", "kind", F.lit("Auto").alias("source"))
    return auto.unionByName(manual.select("folder", "kind", F.lit("Manual").alias("source")))


def _any_size(spark: SparkSession) -> None:
    """A walk may return more rows than recursive queries do by default."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def tree(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, trail) of nodes (id, parent_id, name), from roots down, MAX_HOPS at most."""
    spark = nodes.sparkSession
    _any_size(spark)
    return spark.sql(
        f"""WITH RECURSIVE walk(id, root, depth, trail) AS (
              SELECT id, id, 0, name FROM {{nodes}} WHERE parent_id IS NULL
              UNION ALL
              SELECT n.id, w.root, w.depth + 1, concat(w.trail, ' / ', n.name) FROM walk w JOIN {{nodes}} n ON n.parent_id = w.id WHERE w.depth < {MAX_HOPS})
            SELECT * FROM walk""",
        nodes=nodes,
    )


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, hops): each node's chain of parents, nearest first."""
    _any_size(nodes.sparkSession)
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE up(id, ancestor, hops) AS (
              SELECT id, parent_id, 1 FROM {{nodes}} WHERE parent_id IS NOT NULL
              UNION ALL
              SELECT u.id, n.parent_id, u.hops + 1 FROM up u JOIN {{nodes}} n ON n.id = u.ancestor WHERE n.parent_id IS NOT NULL AND u.hops < {MAX_HOPS})
            SELECT * FROM up""",
        nodes=nodes,
    )


def contexts(nodes: DataFrame, covers: DataFrame) -> DataFrame:
    """(id, trail, cover) of nodes (id, parent_id, name): the names from the top down to the node, and the nearest cover (id, cover) at or above it.

    Each node knows a run of nodes from itself up, and who comes after them; joined with
    the run that begins there it knows one twice as long. MAX_HOPS nodes at most are told,
    also of those that are their own ancestors. A parent that is no node ends the trail.
    """
    at = nodes.join(covers, "id", "left").select("id", F.col("parent_id").alias("next"), F.array("name").alias("names"), "cover")
    for _ in range((MAX_HOPS - 1).bit_length()):
        at = stored(at, "trails")
        if at.where("next is not null").isEmpty():
            break
        above = at.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("names").alias("_names"), F.col("cover").alias("_cover"))
        joined = at.join(above, "next", "left")
        at = joined.select("id", F.col("_next").alias("next"), F.concat("names", F.coalesce("_names", F.array().cast("array<string>"))).alias("names"), F.coalesce("cover", "_cover").alias("cover"))
    return at.select("id", F.reverse("names").alias("trail"), "cover")


def folder_contexts(folded: DataFrame, associated: DataFrame) -> DataFrame:
    """contexts() of the collections among folders, with the covers that lie in them."""
    own = folded.where("is_collection")
    up = own.select(F.col("folder").alias("parent"), F.col("folder").alias("parent_id"))
    nodes = own.join(up, "parent", "left").select(F.col("folder").alias("id"), "parent_id", name_of(F.col("folder")).alias("name"))
    art = associated.where("kind = 'CompanionArt'").select("path", F.col("folder").alias("id")).join(nodes.select("id"), "id", "left_semi")
    return contexts(nodes, best_cover(art, "id"))


def item_contexts(folded: DataFrame, associated: DataFrame, item_covers: DataFrame) -> DataFrame:
    """(item_id, trail, cover) of all items: where they belong, and their own cover (item_id, cover), else the nearest of a collection above.

    What lies in an archive cannot be shown from there, so its own cover is passed over.
    """
    placed = item_collections(folded, associated).join(folder_contexts(folded, associated).withColumnRenamed("id", "collection"), "collection", "left")
    own = item_covers.where(~F.contains("cover", F.lit("!/"))).select("item_id", F.col("cover").alias("own"))
    return placed.join(own, "item_id", "left").select("item_id", F.coalesce("trail", F.array().cast("array<string>")).alias("trail"), F.coalesce("own", "cover").alias("cover"))


def child_counts(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """(id, name, n_children, n_items) of each collection."""
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    own = items.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n_items"))
    return nodes.select("id", "name").join(kids, "id", "left").join(own, "id", "left").fillna({"n_children": 0, "n_items": 0})


def best_cover(images: DataFrame, key: str) -> DataFrame:
    """(key, cover): the image whose name is preferred most, then the first path without case."""
    base = F.lower(F.regexp_replace(name_of(F.col("path")), r"\.[^./\\]*$", ""))
    place = F.array_position(F.array(*[F.lit(x) for x in COVERS]), base)
    return images.groupBy(key).agg(F.min_by("path", F.struct(F.when(place == 0, len(COVERS) + 1).otherwise(place), F.lower("path"), F.col("path"))).alias("cover"))
