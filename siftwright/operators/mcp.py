"""Findings in tool-server configuration documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks a risky server; fixed values.
META = r"[|;`]|\$\(|&&"
NETWORK = r"\b(?:curl|wget|fetch|nc|ncat)\b"
WRAPPED = r"\b(?:bash|sh|zsh|cmd)\b.*\b-c\b"
PREFIX = r"^(?:sk-|sk_|ghp_|gho_|glpat-|xox[bpsa]-|AKIA|npm_|pypi-)"
LOCAL = r"^https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|::1)(?:[:/]|\z)"
#: Files whose servers may stand under another member; fixed value.
SETTINGS = "settings.json"


def servers(documents: DataFrame, key: str = "path") -> DataFrame:
    """``key, server, config`` of every server object; unreadable documents give none.

    Servers are the members of ``servers``; of ``mcp.servers`` only where ``path`` names the settings file. A single text for ``args`` is one
    argument, values of ``env`` that are no texts are ignored, ``tools`` counts as a text only if it is one.
    """
    settings = F.element_at(F.split("path", "/"), -1) == SETTINGS if "path" in documents.columns else F.lit(False)
    other = F.when(settings, F.get_json_object("document", "$.mcp.servers"))
    raw = F.from_json(F.coalesce(F.get_json_object("document", "$.servers"), other), "map<string,string>")
    each = documents.select(key, F.explode(raw).alias("server", "raw")).where(F.ltrim("raw").startswith("{"))
    get = lambda path: F.get_json_object("raw", path)
    args = F.when(F.ltrim(get("$.args")).startswith("["), F.from_json(get("$.args"), "array<string>")).otherwise(F.array(get("$.args")))
    env = F.map_filter(F.from_json(get("$.env"), "map<string,string>"), lambda k, v: v.isNotNull())
    config = F.struct(get("$.command").alias("command"), args.alias("args"), get("$.url").alias("url"), env.alias("env"), get("$.tools").alias("tools"))
    return each.select(key, "server", config.alias("config"))


def findings(documents: DataFrame, key: str = "path") -> DataFrame:
    """``key, server, rule_id, severity, detail``; a secret rule fires once for each variable."""
    s = servers(documents, key)
    command = F.concat_ws(" ", F.coalesce("config.command", F.lit("")), F.array_join(F.coalesce(F.array_compact("config.args"), F.array().cast("array<string>")), " "))
    url = F.coalesce("config.url", F.lit(""))
    row = lambda rule, severity, detail: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), detail.alias("detail"))
    injection = command.rlike(WRAPPED) | (command.rlike(META) & command.rlike(NETWORK))
    single = F.array_compact(
        F.array(
            F.when(injection, row("mcp-shell-injection", 9, F.trim(command))),
            F.when(url.startswith("http://") & ~url.rlike(LOCAL), row("mcp-insecure-http", 7, url)),
            F.when(F.col("config.tools") == "*", row("mcp-wildcard-tools", 6, F.lit("*"))),
        )
    )
    secret = lambda v: (F.length(v) >= 16) & (v.rlike(PREFIX) | v.rlike(r"(?i)^[0-9a-f]{32,}\z") | v.rlike(r"^[A-Za-z0-9+/=]{32,}\z"))
    leaked = F.transform(F.map_keys(F.map_filter(F.coalesce("config.env", F.create_map().cast("map<string,string>")), lambda k, v: secret(v))), lambda k: row("mcp-hardcoded-secret", 8, k))
    return s.select(key, "server", F.explode(F.concat(single, leaked)).alias("f")).select(key, "server", "f.*")
