"""Override files written where they belong: one for each folder, and none where nothing is left to say."""

from __future__ import annotations

from xml.etree import ElementTree as xml

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.scratch import stored
from shelfmark.sources.stores import opened

#: Version of the form that is written.
FORM = "2"


def _entries(parent: xml.Element, rows: pd.DataFrame) -> None:
    """Entries by group and name; text that is long or has a form says so."""
    for r in rows.sort_values(["group", "name", "value"], key=lambda c: c.fillna("")).itertuples():
        big = {"bigText": "big", "formattedText": "formatted"}.get(r.kind)
        own = xml.SubElement(parent, "text" if big else r.kind, {k: v for k, v in (("kind", big), ("group", r.group), ("name", r.name)) if isinstance(v, str)})
        own.text = r.value


def document(rows: pd.DataFrame, root: str) -> bytes | None:
    """The file of one folder's rows, as readers.override_xml() reads them: files, then collections, by name without case; None if no row has a value."""
    rows = rows[rows["value"].fillna("") != ""]
    if rows.empty:
        return None
    top = xml.Element(root, {"version": FORM})
    order = sorted({(r.scope != "file", r.owner.lower(), r.owner, r.scope) for r in rows.itertuples()})
    for _, _, owner, scope in order:
        own = rows[(rows["owner"] == owner) & (rows["scope"] == scope)]
        node = xml.SubElement(top, scope, {"name": owner})
        _entries(node, own[own["sub_name"].isna()])
        below = own[own["sub_name"].notna()]
        if not below.empty:
            parts = xml.SubElement(node, "subResources")
            for (id_, name, kind), part in below.groupby([below["sub_id"].fillna(-1), "sub_name", below["sub_kind"].fillna("")], sort=True):
                named = {"id": str(int(id_))} if id_ >= 0 else {}
                _entries(xml.SubElement(parts, "subResource", {**named, "name": name, "kind": kind.lower()}), part)
    xml.indent(top)
    return xml.tostring(top, "utf-8", xml_declaration=True)


def write_sidecars(overrides: DataFrame, folders: DataFrame, name: str, root: str = "overrides") -> DataFrame:
    """Writes the override file of each folder (of folders: folder, a URI or absolute path); gives (folder, action).

    overrides has folder, scope, owner, sub_id, sub_name, sub_kind, group, name, kind and value. action is "written",
    "deleted" where a file lay and nothing is left to say, or "none". A folder's edits are made by hand, so they fit a
    task. A file is written beside its place and then moved there, so that no reader and no second try sees half of one.
    """
    columns = ["folder", "scope", "owner", "sub_id", "sub_name", "sub_kind", "group", "name", "kind", "value"]
    known = folders.select("folder").distinct()
    rows = known.join(overrides.select(*columns), "folder", "left")

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        store, path = opened(key[0])
        target, action = f"{path.rstrip('/')}/{name}", "none"
        made = document(own[own["scope"].notna()], root)
        if made is not None:
            with store.open_output_stream(f"{target}.part") as out:
                out.write(made)
            store.move(f"{target}.part", target)
            action = "written"
        elif store.get_file_info(target).is_file:
            store.delete_file(target)
            action = "deleted"
        return pd.DataFrame({"folder": [key[0]], "action": [action]})

    done = rows.withColumn("sub_id", F.col("sub_id").cast("double")).groupBy("folder").applyInPandas(run, "folder string, action string")
    return stored(done, "sidecars")
