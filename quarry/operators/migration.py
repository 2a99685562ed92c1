"""Old revision metadata (JSON) as rows of extrinsic metadata: where it is from, what it is about, and its artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Provider prefixes and what they are called.
PROVIDERS = (
    ("https://registry.npmjs.org/", "npm"), ("https://replicate.npmjs.com/", "npm"), ("https://pypi.org/", "pypi"), ("https://cran.r-project.org/", "cran"),
    ("https://guix.gnu.org/sources.json", "nixguix"), ("https://ftp.gnu.org/", "gnu"),
)
#: The format and the authority (type, url) of each provider's metadata; others are named by the caller.
FORMATS = {
    "npm": ("replicate-npm-package-json", "forge", "https://npmjs.com/"), "pypi": ("pypi-project-json", "forge", "https://pypi.org/"),
    "gnu": ("gnu-tree-json", "forge", "https://ftp.gnu.org/"), "nixguix": ("nixguix-sources-json", "forge", None), "deposit": ("sword-v2-atom-codemeta-v2-in-json", "deposit_client", None),
}
#: What an artifact may say, and the names of checksums.
ARTIFACT_KEYS = ("filename", "name", "length", "size", "url", "archive_type", "checksums", "date")
CHECKSUMS = ("sha1", "sha1_git", "sha256", "blake2s256")
#: Fixed value: how a deposit's revision message begins.
DEPOSITED = r"^[a-z-]*: Deposit [0-9]+ in collection [a-z-]+"
ARTIFACT = "array<struct<name string, filename string, length bigint, size bigint, url string, archive_type string, sha1 string, sha1_git string, sha256 string, blake2s256 string, checksums map<string,string>>>"


def _json(path: str, column: str | Column = "metadata") -> Column:
    return F.get_json_object(column, path)


def _listed(column: str | Column = "metadata") -> Column:
    """``original_artifact`` as a JSON list, also where it is one object; of npm's ``package_source`` where that takes its place."""
    own, source = _json("$.original_artifact", column), _json("$.package_source", column)
    return F.when(own.startswith("{"), F.concat(F.lit("["), own, F.lit("]"))).when(own.isNotNull(), own).when(_json("$.package_source.url", column).isNotNull(), F.concat(F.lit("["), source, F.lit("]")))


def provider_of(metadata: str | Column, message: str | Column | None = None, more: tuple[tuple[str, str], ...] = ()) -> Column:
    """The name of the provider a JSON document says it is from, or what its keys and the revision's message show; null if neither does.

    ``more``: whole prefixes of further providers (a deposit server's, a mirror's) and their names. Older rows don't name
    their provider: npm's hold a package's source, deposits' an Atom entry, PyPI's one artifact from its file host; a
    deposit's and an archive's are told by their messages as well.
    """
    url = _json("$.extrinsic.provider", metadata)
    named = F.coalesce(*[F.when(F.startswith(url, F.lit(prefix)), F.lit(name)) for prefix, name in (*PROVIDERS, *more)])
    atom = _json("$['@xmlns']", metadata).isNotNull() | _json("$['{http://www.w3.org/2005/Atom}id']", metadata).isNotNull()
    hosted = _json("$[0].url", _listed(metadata)).startswith("https://files.pythonhosted.org/") & _json("$[1]", _listed(metadata)).isNull()
    guessed = F.when(_json("$.package_source.url", metadata).startswith("https://registry.npmjs.org/"), "npm").when(atom, "deposit").when(hosted, "pypi")
    if message is not None:
        text = (F.col(message) if isinstance(message, str) else message).cast("string")
        guessed = F.coalesce(guessed, F.when(text == "synthetic revision message", "archive").when(text.rlike(DEPOSITED), "deposit"))
    return F.coalesce(named, F.when(url.isNull(), guessed))


def origin_of(provider: Column, metadata: str | Column) -> Column:
    """The origin's url, as far as a url in the document tells it; what is guessed from file names is ``guessed_origins``."""
    url = F.coalesce(_json("$.extrinsic.provider", metadata), _json("$.package_source.url", metadata))
    package = F.regexp_extract(url, r"^https://[^/]+/(?:pypi/)?((?:@[^/]+/)?[^/]+)", 1)
    return (
        F.when(provider == "npm", F.concat(F.lit("https://www.npmjs.com/package/"), package))
        .when((provider == "pypi") & url.isNotNull(), F.concat(F.lit("https://pypi.org/project/"), package, F.lit("/")))
        .when(provider == "cran", F.concat(F.lit("https://cran.r-project.org/package="), F.regexp_extract(url, r"package=([^&]+)", 1)))
        .when(provider == "gnu", F.regexp_extract(url, r"^(https://ftp\.gnu\.org/.*/)[^/]*$", 1))
        .when(provider.isin("nixguix", "deposit"), url)
    )


def guessed_origins(revisions: DataFrame, distribution: str = "Debian") -> DataFrame:
    """``(id, origin)``: every origin that a revision without a named one may be of, by its artifact's file name.

    A PyPI project's name is the file name up to some hyphen or underscore (or whole), without its extension; a Debian
    package's is in ``package_info``. Which of them is right is for ``verify_origins`` to find, for all rows in one join.
    """
    stem = F.regexp_replace(_json("$[0].filename", _listed()), r"\.(tar\.gz|tar\.bz2|tgz|zip|egg|whl)$", "")
    ends = F.filter(F.sequence(F.lit(1), F.length(stem)), lambda k: F.substr(stem, k + 1, F.lit(1)).isin("-", "_", ""))
    python = revisions.where(provider_of("metadata") == "pypi").where(_json("$.extrinsic.provider").isNull() & (F.length(stem) > 0))
    names = python.select("id", F.explode(F.transform(ends, lambda k: F.substr(stem, F.lit(1), k))).alias("name"))
    packages = revisions.where("type = 'dsc'").select("id", _json("$.package_info.name").alias("name")).where("name is not null") if "type" in revisions.columns else None
    out = names.select("id", F.concat(F.lit("https://pypi.org/project/"), "name", F.lit("/")).alias("origin"))
    return out if packages is None else out.unionByName(packages.select("id", F.concat(F.lit(f"deb://{distribution}/packages/"), "name").alias("origin")))


def verify_origins(guessed: DataFrame, statuses: DataFrame, branches: DataFrame) -> DataFrame:
    """Rows of ``guessed(id, origin)`` for which some branch of some snapshot of the origin targets the revision."""
    hits = branches.where("target_type = 'revision'").select(F.col("snapshot_id").alias("snapshot"), F.col("target").alias("id"))
    asked = guessed.select("origin").distinct()
    seen = statuses.where("snapshot is not null").join(asked, "origin", "left_semi").select("origin", "snapshot").distinct().join(hits, "snapshot").select("origin", "id")
    return guessed.join(seen, ["origin", "id"], "left_semi")


def migrate_revision_metadata(revisions: DataFrame, after=None, more: tuple[tuple[str, str], ...] = (), fetcher: tuple[str, str] = ("migrate-metadata", "1"), verified: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metadata rows, rows that no rule takes) from ``revisions(id, date, metadata[, message])``; ``after``: go on past an id.

    Metadata rows are ``(id, provider, origin, discovery_date, format, authority_type, authority_url, fetcher_name,
    fetcher_version, payload)``; a provider without an authority of its own is one, at the root of its url. ``verified(id,
    origin)`` names origins that a url doesn't tell; of several the first. A row whose document has no payload (a lone artifact)
    is taken by its rule and gives no metadata row.
    """
    rows = revisions.where("metadata is not null")
    if after is not None:
        rows = rows.where(F.col("id") > F.lit(after))
    routed = rows.withColumn("provider", provider_of("metadata", "message" if "message" in rows.columns else None, more))
    raw = F.coalesce(_json("$.extrinsic.raw"), F.when(F.col("provider") == "npm", _json("$.package")), F.when(F.col("provider") == "pypi", _json("$.project")))
    payload = F.coalesce(raw, F.when((F.col("provider") == "deposit") | _json("$.extrinsic.provider").isNotNull(), F.col("metadata")))
    when = F.coalesce(F.to_timestamp(_json("$.extrinsic.when")), F.col("date"))
    known = lambda at: F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v[at])])[F.col("provider")]
    host = F.regexp_extract(_json("$.extrinsic.provider"), r"^(https?://[^/]+/)", 1)
    good = routed.where("provider is not null").withColumn("origin", origin_of(F.col("provider"), "metadata"))
    if verified is not None:
        one = verified.groupBy("id").agg(F.min("origin").alias("_found"))
        good = good.join(one, "id", "left").withColumn("origin", F.coalesce("origin", "_found"))
    good = good.select(
        "id", "provider", "origin", when.alias("discovery_date"), F.coalesce(known(0), F.concat("provider", F.lit("-json"))).alias("format"), F.coalesce(known(1), F.lit("forge")).alias("authority_type"),
        F.coalesce(known(2), F.when(F.length(host) > 0, host)).alias("authority_url"), F.lit(fetcher[0]).alias("fetcher_name"), F.lit(fetcher[1]).alias("fetcher_version"), payload.alias("payload"),
    )
    return good.where("payload is not null"), routed.where("provider is null").drop("provider")


def original_artifacts(revisions: DataFrame) -> DataFrame:
    """``(id, artifacts, unknown)``: ``original_artifact`` with name as filename, size as length and all checksums in one map.

    Its date is the package's and goes; ``unknown`` lists keys that artifacts should not have, null where there are none.
    """
    read, texts = F.from_json(_listed(), ARTIFACT), F.from_json(_listed(), "array<string>")

    def normal(a: Column) -> Column:
        flat = F.map_filter(F.create_map(*[x for c in CHECKSUMS for x in (F.lit(c), a[c])]), lambda _, v: v.isNotNull())
        sums = F.when(F.size(flat) > 0, flat).otherwise(a["checksums"])
        return F.struct(F.coalesce(a["filename"], a["name"]).alias("filename"), F.coalesce(a["length"], a["size"]).alias("length"), a["url"].alias("url"), a["archive_type"].alias("archive_type"), sums.alias("checksums"))

    allowed = F.array(*[F.lit(k) for k in (*ARTIFACT_KEYS, *CHECKSUMS)])
    # a package's source also has the package's name and version
    allowed = F.when(_json("$.package_source").isNotNull(), F.array_append(allowed, F.lit("version"))).otherwise(allowed)
    odd = F.array_sort(F.array_except(F.array_distinct(F.flatten(F.transform(texts, F.json_object_keys))), allowed))
    rows = revisions.select("id", F.transform(read, normal).alias("artifacts"), F.when(F.size(odd) > 0, odd).alias("unknown"))
    return rows.where("artifacts is not null")
