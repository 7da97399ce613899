"""From raw (namespace, key, value) rows to typed attributes, by rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import coerce
from shelfmark.operators.scratch import numbered
from shelfmark.plans import vocabulary

RULE_SCHEMA = "namespace string, key string, kind string, definition int, coercer string, keep string, low double, high double"


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules as rows: a few hundred, whatever the data."""
    return spark.createDataFrame([(r.namespace, r.key, r.kind, r.definition, r.coercer, r.keep, r.low, r.high) for r in vocabulary.rules()], RULE_SCHEMA)


def definitions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.id, d.group, d.name, d.type, d.unit, d.read_only) for d in vocabulary.definitions()], "definition int, group string, name string, type string, unit string, read_only boolean")


def aliases_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.alias, a.definition, a.ignore) for a in vocabulary.aliases()], "alias string, definition int, ignored boolean")


def _rule_key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def _coerced(coercers: dict, used: set[str], kind: str) -> Column:
    """The value by the coercers that rules in question use."""
    v = F.col("part")
    own = [(name, f) for name, f in coercers.items() if name in used]
    if not own:
        return F.lit(None).cast(kind)
    return reduce(lambda out, item: out.when(F.col("coercer") == item[0], item[1](v)), own[1:], F.when(F.col("coercer") == own[0][0], own[0][1](v)))


def normalize(raw: DataFrame, definitions: Iterable[int] | None = None) -> DataFrame:
    """Typed attributes of raw rows: all rows of a rule's values that coerce, pass its filter and lie in its range.

    Adds definition, kind and value_text, value_int, value_float or value_date. The
    rules are a fixed table and are broadcast; nothing else moves. With definitions
    given, only the rules of these are applied.
    """
    wanted = None if definitions is None else set(definitions)
    used = {r.coercer for r in vocabulary.rules() if wanted is None or r.definition in wanted}
    rules = rules_table(raw.sparkSession)
    rules = rules if wanted is None else rules.where(F.col("definition").isin(*sorted(wanted)))
    rules = F.broadcast(rules.withColumnsRenamed({"namespace": "rule_ns", "key": "rule_key"}))
    ruled = raw.join(rules, (_rule_key("namespace") == F.col("rule_ns")) & (_rule_key("key") == F.col("rule_key")))
    value = F.replace(F.col("value"), F.lit("\x00"), F.lit(""))
    parts = ruled.withColumn("part", F.explode(F.when(F.col("kind") == "texts", coerce.split_values(value)).otherwise(F.array(value))))
    kept = parts.where(F.when(F.col("keep") == "meaningful_tag", coerce.meaningful_tag(F.col("part"))).when(F.col("keep") == "real_date", coerce.real_date(F.col("part"))).otherwise(True))
    typed = kept.withColumns({"value_text": _coerced(coerce.TEXT_COERCERS, used, "string"), "value_int": _coerced(coerce.INTEGER_COERCERS, used, "long"), "value_float": _coerced(coerce.FLOAT_COERCERS, used, "double"), "value_date": _coerced(coerce.DATE_COERCERS, used, "timestamp")})
    number = F.coalesce(F.col("value_int").cast("double"), "value_float")
    found = F.coalesce(F.col("value_text"), F.col("value_int").cast("string"), F.col("value_float").cast("string"), F.col("value_date").cast("string")).isNotNull()
    inside = F.coalesce(number >= F.col("low"), F.lit(True)) & F.coalesce(number <= F.col("high"), F.lit(True))
    return typed.where(found & inside).drop("rule_ns", "rule_key", "coercer", "keep", "low", "high", "part", "value")


def value_key(blob: str | None = None) -> Column:
    """The text by which equal values are told: text and numbers as they are, dates in UTC to the last digit; blob names a column of bytes, if there is one."""
    date = F.date_format(F.to_utc_timestamp("value_date", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
    other = [F.base64(blob)] if blob else []
    return F.coalesce(F.col("value_text"), F.col("value_int").cast("string"), F.col("value_float").cast("string"), date, *other)


def first_wins(attributes: DataFrame, order: str = "seq") -> DataFrame:
    """Of equal values of a file's definition, the first by order."""
    w = Window.partitionBy("file_id", "definition", "value_key").orderBy(order, "namespace", "key")
    return attributes.withColumn("value_key", value_key("value_blob" if "value_blob" in attributes.columns else None)).withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def unmapped(raw: DataFrame) -> DataFrame:
    """(namespace, key, n, sample) of raw keys without a rule."""
    rules = F.broadcast(rules_table(raw.sparkSession).select(F.col("namespace").alias("rule_ns"), F.col("key").alias("rule_key")))
    counts = raw.groupBy("namespace", "key").agg(F.count("*").alias("n"), F.max("value").alias("sample"))
    return counts.join(rules, (_rule_key("namespace") == F.col("rule_ns")) & (_rule_key("key") == F.col("rule_key")), "left_anti")


def fits_type(value: Column, kind: Column) -> Column:
    """Whether a text can be a value of a type; any can be text, none is bytes."""
    whole, floating = coerce.integer(value).isNotNull(), coerce.floating(value).isNotNull()
    return (
        F.when(kind == "Integer", whole).when(kind == "Float", floating).when(kind == "Date", coerce.iso_date(value).isNotNull())
        .when(kind == "TimeSpan", coerce.duration(value).isNotNull()).when(kind == "Blob", F.lit(False)).otherwise(F.lit(True))
    )


def resolve_aliases(pairs: DataFrame, name: str = "name", value: str | None = None) -> DataFrame:
    """pairs with the definition their name is an alias of, else the first one of that name; ignored aliases drop out.

    With value, only definitions whose type the value fits are taken by name; an alias holds whatever
    the value. definition is null for names that are new to the vocabulary, or new with such a value.
    """
    spark = pairs.sparkSession
    alias = F.broadcast(aliases_table(spark).withColumnRenamed("definition", "alias_definition"))
    known = definitions_table(spark).groupBy(F.lower(F.trim("name")).alias("known")).agg(F.array_sort(F.collect_list(F.struct("definition", "type"))).alias("named"))
    key = F.lower(F.trim(F.col(name)))
    out = pairs.join(alias, key == F.col("alias"), "left").join(F.broadcast(known), key == F.col("known"), "left").where(~F.coalesce("ignored", F.lit(False)))
    fit = F.col("named") if value is None else F.filter("named", lambda d: fits_type(F.col(value), d["type"]))
    return out.withColumn("definition", F.coalesce("alias_definition", F.get(fit, 0)["definition"])).drop("alias", "ignored", "known", "alias_definition", "named")


def mint_definitions(names: DataFrame, first_id: int = 1_000_000) -> DataFrame:
    """(name, definition) of new names, numbered in their order from first_id on."""
    return numbered(names.where("definition is null").select("name").distinct(), ["name"], "definition", first_id)


#: The provider of attributes that sidecars gave to their primary file.
PROMOTION = "promotion"


def replace_derived(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """old with the attributes of changed files (file_id) replaced by new; promoted ones stay, as no extractor gives them again."""
    touched = changed.select("file_id").distinct().withColumn("touched", F.lit(True))
    kept = old.join(touched, "file_id", "left").where(F.col("touched").isNull() | (F.col("provider") == PROMOTION)).drop("touched")
    return kept.unionByName(new)


def renormalize(attributes: DataFrame, raw: DataFrame, definitions: Iterable[int] | None = None) -> DataFrame:
    """(file_id, definition, value_key, provider): attributes with those of raw's providers rebuilt from raw.

    raw has a provider too. Attributes of other providers of the same files stay;
    equal values of a file's definition are kept once, from the first by seq.
    """
    keys = raw.select("file_id", "provider").distinct()
    kept = attributes.join(keys, ["file_id", "provider"], "left_anti").select("file_id", "definition", "value_key", "provider")
    return kept.unionByName(first_wins(normalize(raw, definitions)).select("file_id", "definition", "value_key", "provider"))


def subresources(found: DataFrame, known: DataFrame) -> DataFrame:
    """known (sub_id, file_id, internal_id, kind, name) and the rows of found it lacks, numbered on from its largest sub_id."""
    key = ["file_id", "internal_id", "kind", "name"]
    fresh = found.select(*key).distinct().alias("f").join(known.select(*key).alias("k"), [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key], "left_anti")
    last = known.agg(F.coalesce(F.max("sub_id"), F.lit(0))).first()[0]
    return known.select("sub_id", *key).unionByName(numbered(fresh, key, "sub_id", last + 1).select("sub_id", *key))


def without_promotions(attributes: DataFrame) -> DataFrame:
    return attributes.where(F.col("provider") != PROMOTION)


def reset_files(files: DataFrame) -> DataFrame:
    """files (file_id, role, role_source, item_id, collection_id) as before they were grouped; what was set by hand stays."""
    auto = F.col("role_source") == "Auto"
    return files.withColumns({"role": F.when(auto, "Primary").otherwise(F.col("role")), "item_id": F.when(~auto, F.col("item_id")), "collection_id": F.when(~auto, F.col("collection_id"))})


def reset_collections(collections: DataFrame) -> DataFrame:
    """The collections (id, parent_id, role_source) set by hand; their parents go with the others."""
    auto = collections.where("role_source = 'Auto'").select(F.col("id").alias("parent_id"), F.lit(True).alias("gone"))
    left = collections.where("role_source <> 'Auto'").join(auto, "parent_id", "left")
    return left.select("id", F.when(F.col("gone").isNull(), F.col("parent_id")).alias("parent_id"), "role_source")


def unmapped_top(raw: DataFrame, top: int = 15) -> DataFrame:
    """The unmapped keys with most values, then by namespace and key."""
    return unmapped(raw).orderBy(F.desc("n"), "namespace", "key").limit(top)
