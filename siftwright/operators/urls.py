"""URL topology: parsing, hosts, paths, parameters and their herd gate, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S

#: Hosts, suffixes and paths that are internal or sensitive; fixed values.
PRIVATE = ("10.", *(f"172.{i}." for i in range(16, 32)), "192.168.", "127.", "0.0.0.0", "::1", "localhost")
SUFFIXES = (".local", ".svc", ".internal", ".cluster.local", ".lan", ".corp", ".home", ".intranet")
SENSITIVE = (
    "/admin", "/console", "/management", "/metrics", "/health", "/debug", "/actuator", "/api/internal", "/_internal", "/backstage", "/private",
    "/internal",
)


def _esc(text: str) -> str:
    return text.replace(".", r"\.")


def parse(url: Column) -> Column:
    """``struct(scheme, authority, host, port, path, query, fragment)``; user info stays part of the host."""
    has_scheme = F.instr(url, "://") > 0
    scheme = F.when(has_scheme, F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))).otherwise("")
    rest = F.when(has_scheme, F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)).otherwise(url)
    fragment = F.regexp_extract(rest, r"(?s)^[^#]*#(.*)\z", 1)
    rest = F.regexp_extract(rest, r"^([^#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)\z", 1)
    rest = F.regexp_extract(rest, r"^([^?]*)", 1)
    authority = F.regexp_extract(rest, r"^([^/]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/]*(/.*)\z", 1)
    ported = authority.rlike(r":[^:\]]*\z")
    host = F.when(ported, F.regexp_extract(authority, r"(?s)^(.*):[^:\]]*\z", 1)).otherwise(authority)
    port = F.when(ported, F.regexp_extract(authority, r":([^:\]]*)\z", 1)).otherwise("")
    host = F.regexp_replace(host, r"[\x27\x22`;,)\]}>]+\z", "")
    return F.struct(scheme.alias("scheme"), authority.alias("authority"), host.alias("host"), port.alias("port"), path.alias("path"), query.alias("query"), fragment.alias("fragment"))


def is_internal(host: Column) -> Column:
    h = F.lower(host)
    return h.rlike("^(?:" + "|".join(map(_esc, PRIVATE)) + ")") | h.rlike(r"(?:^|\.)(?:" + "|".join(_esc(s[1:]) for s in SUFFIXES) + r")\z")


def is_sensitive(path: Column) -> Column:
    return F.lower(path).rlike("|".join(SENSITIVE))


def params(query: Column) -> Column:
    """``array<struct(key, value)>`` of the parameters whose decoded value has 4 characters or more."""
    parts = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    decoded = lambda v: F.replace(F.replace(F.replace(v, F.lit("%20"), F.lit(" ")), F.lit("%3D"), F.lit("=")), F.lit("%26"), F.lit("&"))
    each = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?s)^([^=]*)=", 1).alias("key"), decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)\z", 1)).alias("value")))
    return F.filter(each, lambda kv: F.length(kv["value"]) >= 4)


def gated(exploded: DataFrame, key: str) -> DataFrame:
    """Parameters that pass their URL's herd gate: three or more of nearly equal entropy are data, not secrets."""
    h = exploded.withColumn("h", S.entropy(F.col("value")))
    stats = h.groupBy(key).agg(F.count("*").alias("n"), F.var_pop("h").alias("var"), (F.max("h") - F.min("h")).alias("ihd"))
    dropped = (F.col("n") >= 3) & (S.r9(F.col("var")) < 0.4) & (S.r9(F.col("ihd")) <= 1.5)
    return h.join(stats, key).where(~dropped).drop("n", "var", "ihd", "h")


def classification(internal: Column, secret_param: Column, scheme: Column, sensitive: Column) -> Column:
    return (
        F.when(internal, "internal-exposed").when(secret_param, "sensitive-parameter").when((scheme == "http") & sensitive, "suspicious-external").otherwise("safe-external")
    )
