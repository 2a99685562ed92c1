"""Hashes, object identifiers and the manifests they are taken from (the public git formats)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import ArgumentError
from quarry.schemas import HASHES, TYPE_CODES


def git_object_id(kind: str, manifest: Column) -> Column:
    """Hex SHA-1 of ``<kind> <length>\\0<manifest>``, for binary or string manifests."""
    data = manifest.cast("binary")
    head = F.concat(F.lit(f"{kind} "), F.octet_length(data).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.lit(bytearray(b"\0")), data))


@F.pandas_udf(T.StringType())
def blake2s256(data: pd.Series) -> pd.Series:
    """Hex BLAKE2s-256, which Spark has no function for; null stays null."""
    return data.map(lambda x: None if x is None else hashlib.blake2s(x if isinstance(x, bytes) else bytes(x)).hexdigest())


def content_hashes(data: str | Column) -> dict[str, Column]:
    """The four hex hashes of a content, by name."""
    own = (F.col(data) if isinstance(data, str) else data).cast("binary")
    return {"sha1": F.sha1(own), "sha1_git": git_object_id("blob", own), "sha256": F.sha2(own, 256), "blake2s256": blake2s256(own)}


def identifier(kind: str | Column, hex_id: Column, scheme: str = "obj:1") -> Column:
    """``<scheme>:<type code>:<lower-case hex id>``; null if the type has no code."""
    named = F.lit(kind) if isinstance(kind, str) else kind
    code = F.create_map(*[F.lit(x) for pair in TYPE_CODES.items() for x in pair])[named]
    return F.concat(F.lit(f"{scheme}:"), code, F.lit(":"), F.lower(hex_id))


def parse_identifier(text: Column) -> Column:
    """Struct (object_type, id) of an identifier; an error if it has qualifiers or isn't one."""
    kind = F.create_map(*[F.lit(x) for k, v in TYPE_CODES.items() for x in (v, k)])
    parts = F.split(text, ":")
    good = text.rlike("^[a-z]+:[0-9]+:[a-z]{3}:[0-9a-f]{40}$")
    checked = F.when(good | text.isNull(), text).otherwise(F.raise_error(F.concat(F.lit("not a plain identifier: "), text)))
    return F.when(checked.isNotNull(), F.struct(kind[parts[2]].alias("object_type"), parts[3].alias("id")))


def directory_manifest(entries: list[dict]) -> bytes:
    """Git tree: entries by name, directories as if their names ended with a slash."""
    ordered = sorted(entries, key=lambda e: e["name"] + (b"/" if e["type"] == "dir" else b""))
    return b"".join(b"%o %s\0%s" % (e["perms"], e["name"], e["target"]) for e in ordered)


def _when(date: dict | None) -> bytes:
    """Seconds, with microseconds if there are any, and the offset as it was written."""
    seconds, micros = date["seconds"], date["microseconds"] or 0
    text = str(seconds) if not micros else f"{seconds}.{micros:06d}".rstrip("0")
    return b"%s %s" % (text.encode(), date["offset_bytes"])


def _signed(key: bytes, person: dict, date: dict | None) -> bytes:
    return key + b" " + person["fullname"].replace(b"\n", b"\n ") + (b" " + _when(date) if date else b"") + b"\n"


def revision_manifest(rev: dict) -> bytes:
    """Git commit: tree, parents by rank, author, committer, extra headers, message."""
    out = b"tree %s\n" % rev["directory"].hex().encode()
    out += b"".join(b"parent %s\n" % p.hex().encode() for p in rev.get("parents") or [])
    out += _signed(b"author", rev["author"], rev["date"]) if rev.get("author") else b""
    out += _signed(b"committer", rev["committer"], rev["committer_date"]) if rev.get("committer") else b""
    out += b"".join(k + b" " + v.replace(b"\n", b"\n ") + b"\n" for k, v in rev.get("extra_headers") or [])
    return out + (b"\n" + rev["message"] if rev.get("message") is not None else b"")


def release_manifest(rel: dict) -> bytes:
    """Git tag. The type of a content is written blob, of a directory tree, of a revision commit, of a release tag."""
    kinds = {"content": b"blob", "directory": b"tree", "revision": b"commit", "release": b"tag", "snapshot": b"refs"}
    out = b"object %s\ntype %s\n" % (rel["target"].hex().encode(), kinds[rel["target_type"]]) + b"tag " + rel["name"].replace(b"\n", b"\n ") + b"\n"
    out += _signed(b"tagger", rel["author"], rel["date"]) if rel.get("author") else b""
    return out + (b"\n" + rel["message"] if rel.get("message") is not None else b"")


def snapshot_manifest(branches: list[dict]) -> bytes:
    """Branches by name: type, name, length of the target and the target; an empty branch is dangling."""
    out = b""
    for b in sorted(branches, key=lambda b: b["name"]):
        target = b["target"] if b["target"] is not None else b""
        kind = (b["target_type"] or "dangling").encode()
        out += b"%s %s\0%d:%s" % (kind, b["name"], len(target), target)
    return out


#: Manifest of a gathered row, by object type, and the git name of the type.
MANIFESTS = {
    "directory": ("tree", lambda r: directory_manifest(r["entries"] or [])),
    "revision": ("commit", revision_manifest),
    "release": ("tag", release_manifest),
    "snapshot": ("snapshot", lambda r: snapshot_manifest(r["branches"] or [])),
}


def object_id(kind: str, row: dict) -> bytes:
    """The intrinsic id of a gathered object; a raw manifest wins over the one made from its fields."""
    name, make = MANIFESTS[kind]
    manifest = row.get("raw_manifest")
    if manifest is None:
        manifest = make(row)
    return hashlib.sha1(b"%s %d\0" % (name.encode(), len(manifest)) + bytes(manifest)).digest()


def check_hash_name(algo: str) -> str:
    if algo not in HASHES:
        raise ArgumentError(f"unknown hash {algo}")
    return algo


def tree_manifest(entries: str) -> Column:
    """``directory_manifest`` of a column of entries, by built-in functions; null where a field is."""
    return F.unhex(_tree(F.col(entries)))


def _tree(entries: Column) -> Column:
    """``directory_manifest`` of an array of entries, in hexadecimal."""
    named = F.transform(entries, lambda e: F.struct(F.when(e["type"] == "dir", F.concat(e["name"], F.lit(bytearray(b"/")))).otherwise(e["name"]).alias("by"), e.alias("e")))
    head = lambda e: F.concat(F.conv(e["perms"].cast("string"), 10, 8), F.lit(" ")).cast("binary")
    return _joined(F.transform(F.array_sort(named), lambda x: F.concat(head(x["e"]), x["e"]["name"], F.lit(bytearray(b"\0")), x["e"]["target"])))


def _refs(branches: Column) -> Column:
    """``snapshot_manifest`` of an array of branches, in hexadecimal."""
    named = F.transform(branches, lambda b: F.struct(b["name"].alias("by"), b.alias("b")))
    target = lambda b: F.coalesce(b["target"], F.lit(bytearray()))
    kind = lambda b: F.concat(F.coalesce(b["target_type"], F.lit("dangling")), F.lit(" ")).cast("binary")
    size = lambda b: F.concat(F.octet_length(target(b)).cast("string"), F.lit(":")).cast("binary")
    return _joined(F.transform(F.array_sort(named), lambda x: F.concat(kind(x["b"]), x["b"]["name"], F.lit(bytearray(b"\0")), size(x["b"]), target(x["b"]))))


def _joined(parts: Column) -> Column:
    """Null if one part is, as then no manifest can be made."""
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(F.transform(parts, F.hex), ""))


def validate_objects(kind: str, objects: DataFrame) -> DataFrame:
    """Gathered directories, revisions, releases or snapshots with ``valid boolean``: whether their id is that of their manifest.

    A row that no manifest can be made from is not valid. Directories and snapshots are checked by built-in functions; commits
    and tags, whose persons and dates have forms of their own, in Arrow batches.
    """
    if kind in ("directory", "snapshot"):
        given = F.col("entries" if kind == "directory" else "branches")
        made = F.unhex((_tree if kind == "directory" else _refs)(F.coalesce(given, F.array().cast(objects.schema["entries" if kind == "directory" else "branches"].dataType))))
        manifest = F.coalesce("raw_manifest", made) if "raw_manifest" in objects.columns else made
        return objects.withColumn("valid", F.coalesce(git_object_id(MANIFESTS[kind][0], manifest) == F.lower(F.hex("id")), F.lit(False)))

    def check(row: dict) -> bool:
        try:
            return object_id(kind, row) == row["id"]
        except (KeyError, TypeError, AttributeError):
            return False

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = pa.array([check(row) for row in batch.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, valid], names=[*batch.schema.names, "valid"])

    return objects.mapInArrow(mark, T.StructType([*objects.schema.fields, T.StructField("valid", T.BooleanType())]))
