"""Schemas of the archive's tables. Hashes, names and manifests are bytes; times are UTC."""

from __future__ import annotations

from pyspark.sql import types as T

_B, _S, _L, _I, _T = T.BinaryType(), T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()
PERSON = T.StructType().add("fullname", _B).add("name", _B).add("email", _B)
DATE = T.StructType().add("seconds", _L).add("microseconds", _I).add("offset_bytes", _B)
HASHES = ("sha1", "sha1_git", "sha256", "blake2s256")


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_HASHED = dict.fromkeys(HASHES, _B)
_PERSONAL = {"author": PERSON, "date": DATE}
TABLES = {
    "content": _table(**_HASHED, length=_L, status=_S, ctime=_T),
    "content_data": _table(sha256=_B, data=_B),
    "skipped_content": _table(**_HASHED, length=_L, status=_S, reason=_S, origin=_S, ctime=_T),
    "directory": _table(id=_B, raw_manifest=_B),
    "directory_entry": _table(directory_id=_B, name=_B, type=_S, target=_B, perms=_I),
    "revision": _table(
        id=_B, message=_B, **_PERSONAL, committer=PERSON, committer_date=DATE, type=_S, directory=_B, synthetic=T.BooleanType(),
        extra_headers=T.ArrayType(T.ArrayType(_B)), raw_manifest=_B,
    ),
    "revision_parent": _table(id=_B, parent_rank=_I, parent_id=_B),
    "release": _table(id=_B, name=_B, message=_B, target=_B, target_type=_S, **_PERSONAL, synthetic=T.BooleanType(), raw_manifest=_B),
    "snapshot": _table(id=_B),
    "snapshot_branch": _table(snapshot_id=_B, name=_B, target_type=_S, target=_B),
    "origin": _table(url=_S, sha1=_B),
    "origin_visit": _table(origin=_S, visit=_L, date=_T, type=_S),
    "origin_visit_status": _table(origin=_S, visit=_L, date=_T, type=_S, status=_S, snapshot=_B),
    "extid": _table(extid_type=_S, extid=_B, extid_version=_L, target_type=_S, target=_B),
    "metadata_authority": _table(type=_S, url=_S),
    "metadata_fetcher": _table(name=_S, version=_S),
    "raw_extrinsic_metadata": _table(
        id=_B, target_type=_S, target=_S, discovery_date=_T, authority_type=_S, authority_url=_S, fetcher_name=_S, fetcher_version=_S, format=_S, payload=_B,
        origin=_S, visit=_L, snapshot=_S, release=_S, revision=_S, path=_B, directory=_S,
    ),
    "object_reference": _table(source_type=_S, source=_B, target_type=_S, target=_B, date=T.DateType(), iso_year=_I, iso_week=_I),
    "mask_request": _table(id=_S, slug=_S, reason=_S, date=_T),
    "mask_history": _table(request=_S, date=_T, message=_S),
    "masked_object": _table(object_id=_S, object_type=_S, request=_S, state=_S),
    "display_name": _table(original_email=_B, display_name=_B),
    "block_request": _table(id=_S, slug=_S, reason=_S, date=_T),
    "block_history": _table(request=_S, date=_T, message=_S),
    "blocked_origin": _table(url_match=_S, request=_S, state=_S),
    "blocked_origin_log": _table(url=_S, url_match=_S, request=_S, state=_S, date=_T),
}
#: Allowed names.
VISIT_STATES = ("created", "ongoing", "full", "partial", "not_found", "failed")
REVISION_TYPES = ("git", "tar", "dsc", "svn", "hg", "cvs", "bzr")
TARGET_TYPES = ("content", "directory", "revision", "release", "snapshot", "alias")
MASKED_STATES = ("visible", "decision_pending", "restricted")
BLOCKED_STATES = ("non_blocked", "decision_pending", "blocked")
#: Short names of object types in identifiers.
TYPE_CODES = {"content": "cnt", "directory": "dir", "revision": "rev", "release": "rel", "snapshot": "snp", "origin": "ori", "raw_extrinsic_metadata": "emd"}
