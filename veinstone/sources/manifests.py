"""Dependency manifests as tables, and the technologies they tell of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions.names import manifest_kind, package_root

_NONE = "cast(array() as array<string>)"
#: The lists of a package.json that declare packages, and the ecosystem that each kind of manifest names (fixed values).
_LISTS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
_ECOSYSTEM = {"package.json": "npm", "requirements": "pypi", "pyproject": "pypi", "pipfile": "pypi", "cargo": "cargo", "go.mod": "go"}


def _lines(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?m)" + pattern), F.lit(1))


def _section(text: Column, heads: str) -> Column:
    """The lines of the tables of a TOML text whose heads match."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?ms)^\[(?:" + heads + r")\]\s*$(.*?)(?=^\[|\z)"), F.lit(1)), "\n")


def _names(kind: Column, text: Column) -> Column:
    listed = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{k}"), "map<string,string>")), F.expr(_NONE)) for k in _LISTS])))
    quoted = F.flatten(F.transform(_lines(text, r"^(?:dependencies|[\w-]+)\s*=\s*\[([^\]]*)\]"), lambda x: F.regexp_extract_all(x, F.lit(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)"), F.lit(1))))
    return (
        F.when(kind == "package.json", listed)
        .when(kind == "requirements", _lines(text, r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)"))
        .when(kind == "pyproject", F.concat(quoted, F.filter(_lines(_section(text, r"tool\.poetry(?:\.group\.[\w-]+)?\.dependencies"), r"^([A-Za-z0-9][\w.-]*)\s*="), lambda n: n != "python")))
        .when(kind == "pipfile", _lines(_section(text, "packages|dev-packages"), r"^\"?([A-Za-z0-9][\w.-]*)\"?\s*="))
        .when(kind == "cargo", _lines(_section(text, r"(?:dev-|build-|workspace\.)?dependencies"), r"^([A-Za-z0-9_-]+)\s*="))
        .when(kind == "go.mod", _lines(text, r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v\S+"))
        .otherwise(F.expr(_NONE))
    )


def declared(files: DataFrame) -> DataFrame:
    """(path, kind, ecosystem, name) of the packages that manifests among files(path, text) declare; images of compose files are of the
    ecosystem 'image', as written but for tag and digest. Names are in lower case; a text that can't be read declares nothing."""
    m = files.where("text is not null").select("path", "text", manifest_kind(F.col("path")).alias("kind")).where("kind is not null")
    image = F.transform(_lines(F.col("text"), r"^\s*image:\s*[\"']?([^\s\"'#]+)"), lambda i: F.regexp_replace(F.regexp_replace(i, "@.*$", ""), ":[^/:]*$", ""))
    names = F.when(F.col("kind") == "compose", image).otherwise(_names(F.col("kind"), F.col("text")))
    of = F.lit("image")
    for kind, ecosystem in _ECOSYSTEM.items():
        of = F.when(F.col("kind") == kind, ecosystem).otherwise(of)
    return m.select("path", "kind", of.alias("ecosystem"), F.explode(F.transform(names, F.lower)).alias("name")).distinct()


def detected(packages: DataFrame, imports: DataFrame, technologies: DataFrame) -> DataFrame:
    """(technology, evidence, importers) from declared's packages, imports(path, specifier) and technologies(technology, ecosystem, name,
    prefix boolean): a package names a technology by its name, or by a name and / or - behind it where prefix says so.

    evidence: the declaring file of fewest folders, then the smaller path; importers: how many files import it. Technologies that are imported only have no evidence."""
    found = F.when(F.col("path").endswith(".py"), "pypi").when(F.col("path").endswith(".rs"), "cargo").otherwise("npm")
    used = imports.select("path", found.alias("ecosystem"), F.lower(package_root(F.col("path"), F.col("specifier"))).alias("name")).where("name is not null").distinct()
    # a name is looked up as it is and by each of its beginnings, so that the table of technologies is joined by equality
    ends = F.filter(F.sequence(F.lit(1), F.length("name")), lambda n: (n == F.length("name")) | F.substring("name", n + 1, F.lit(1)).isin("/", "-"))
    starts = lambda d: d.withColumn("at", F.explode(F.transform(ends, lambda n: F.struct(F.substring("name", F.lit(1), n).alias("name"), (n < F.length("name")).alias("short")))))
    t = technologies.select("technology", "ecosystem", F.lower("name").alias("_name"), "prefix")
    match = lambda d: starts(d).withColumn("_name", F.col("at.name")).join(t, ["ecosystem", "_name"]).where(~F.col("at.short") | F.col("prefix"))
    said = match(packages.select("path", "ecosystem", "name")).groupBy("technology").agg(F.min(F.struct(F.size(F.split("path", "/")).alias("depth"), "path")).alias("m"))
    by = match(used).groupBy("technology").agg(F.countDistinct("path").alias("importers"))
    return said.join(by, "technology", "full_outer").select("technology", F.col("m.path").alias("evidence"), F.coalesce("importers", F.lit(0)).alias("importers"))
