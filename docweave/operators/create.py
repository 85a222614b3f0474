"""Creation of nodes in bulk: each function turns rows into nodes ``id, labels, properties, embedding``.

A node's id is the given one or, where that is null, one that follows from the
row's content, so a retried task creates the same nodes. Properties are a map of
text; which of two values of one key stays is said with each kind. Append the
result to the stored node table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import iso_stamp, make_id, merged

_NO_VECTOR = "array<double>"


def _map(pairs: dict[str, Column]) -> Column:
    """A map of the values that are not null."""
    whole = F.create_map(*[x for key, value in pairs.items() for x in (F.lit(key), value.cast("string"))])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def _given(rows: DataFrame, name: str, kind: str) -> Column:
    """A column if the rows have it, else null."""
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def _properties(rows: DataFrame, name: str) -> Column:
    return F.coalesce(_given(rows, name, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _created(rows: DataFrame, label: str, own: dict[str, Column], before: Column | None, after: list[Column], stamp: Column, embedding: str | None = None) -> DataFrame:
    """Own properties win over those ``before`` them and lose to those ``after`` them."""
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    out = rows.withColumn("_id", F.coalesce(_given(rows, "id", "string"), make_id(F.lit(label), content)))
    properties = _map({"id": F.col("_id"), **own, "created_at": stamp})
    if before is not None:
        properties = merged(before, properties)
    for more in after:
        properties = merged(properties, more)
    labels = F.concat(F.array(F.lit(label)), F.coalesce(_given(rows, "labels", "array<string>"), F.array().cast("array<string>")))
    vector = F.col(embedding).cast(_NO_VECTOR) if embedding and embedding in rows.columns else F.lit(None).cast(_NO_VECTOR)
    # The node goes by its id property, which what comes after may set.
    return out.select(properties.alias("properties"), labels.alias("labels"), vector.alias("embedding")).select(F.element_at("properties", "id").alias("id"), "labels", "properties", "embedding")


def _now(stamp: Column | None) -> Column:
    return iso_stamp(F.current_timestamp()) if stamp is None else stamp


def entities(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``rows(name, type[, id, labels, properties])``; name, type, id and stamp win over properties."""
    return _created(rows, "Entity", {"name": F.col("name"), "type": F.col("type")}, _properties(rows, "properties"), [], _now(stamp))


def entity_batch(batches: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``batches(entities array<struct<name, type, ...>>)``, each element an entity."""
    return entities(batches.select(F.inline("entities")), stamp)


def documents(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``rows(file_name[, type, id])``; a document without a type is ``unknown``."""
    return _created(rows, "Document", {"file_name": F.col("file_name"), "type": F.coalesce(_given(rows, "type", "string"), F.lit("unknown"))}, None, [], _now(stamp))


def chunks(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``rows(text, summary, chunk_number, embedding, metadata[, id])``; metadata wins over all else."""
    own = {c: F.col(c) for c in ("text", "summary", "chunk_number")}
    return _created(rows, "Chunk", own, None, [_properties(rows, "metadata")], _now(stamp), "embedding")


def descriptions(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``rows(text[, embeddings, id, properties])``; text, id and stamp win over properties."""
    return _created(rows, "Description", {"text": F.col("text")}, _properties(rows, "properties"), [], _now(stamp), "embeddings")


def tables(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``rows(name, columns array<string>[, id, properties])`` with ``columns`` and ``column_count``; these win over properties."""
    columns = F.coalesce(F.col("columns"), F.array().cast("array<string>"))
    own = {"name": F.col("name"), "columns": F.array_join(columns, ", "), "column_count": F.size(columns)}
    return _created(rows, "Table", own, _properties(rows, "properties"), [], _now(stamp))


def items(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``rows(name, item_properties[, additional_properties, id])``; each kind of properties wins over the one before."""
    return _created(rows, "Item", {"name": F.col("name")}, None, [_properties(rows, "item_properties"), _properties(rows, "additional_properties")], _now(stamp))


def relationships(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``rows(type[, id, properties])`` as nodes; type, id and stamp win over properties."""
    return _created(rows, "Relationship", {"type": F.col("type")}, _properties(rows, "properties"), [], _now(stamp))


def has_label(label: str, labels: str = "labels") -> Column:
    """Whether a node has a label, among others perhaps."""
    return F.array_contains(labels, label)


def clear(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Delete a stored graph; nothing happens without ``confirm``, which is an error."""
    if not confirm:
        raise ValueError("say confirm=True to delete the graph")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sample(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows in an order that a hash of key and seed shuffles: the same ones in every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
