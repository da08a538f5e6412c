"""Per-file classification: territory, role, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by which paths tell a file's part; fixed values.
BACKEND = ("server", "api", "route", "controller", "middleware", "handler", "model", "db", "migration", "worker", "cron", "queue")
FRONTEND = ("component", "page", "view", "layout", "hook", "context", "store", "ui", "widget", "screen")
CONFIG = ("config", "setting", "option", "env", "constant")
LOGIC = ("service", "util", "helper", "lib", "core", "engine", "processor", "transform", "parser", "builder", "factory", "validator")
TEST_MARKS = ("test/", "tests/", "__tests__/", ".test.", ".spec.")


def _any(path: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in parts])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def territory(path: Column) -> Column:
    """First match of vendor, dist, node_modules, test, config; else application. Substrings, not path segments."""
    name = basename(path)
    first_rc = F.instr(name, ".rc")
    config = F.contains(name, F.lit("config")) | F.contains(name, F.lit(".rc.")) | ((first_rc > 0) & (first_rc == F.length(name) - 2)) | F.contains(path, F.lit("config/"))
    return (
        F.when(F.contains(path, F.lit("vendor")), "vendor")
        .when(_any(path, ("dist/", "build/")), "dist")
        .when(F.contains(path, F.lit("node_modules")), "node_modules")
        .when(_any(path, TEST_MARKS), "test")
        .when(config, "config")
        .otherwise("application")
    )


def names_segment(path: Column, words: list[str]) -> Column:
    """One of the words stands after a slash, or before a slash or dot."""
    alternatives = "|".join(words)
    return F.lower(path).rlike(rf"/(?:{alternatives})|(?:{alternatives})[/.]")


def role(path: Column, ext: Column) -> Column:
    """``struct(context_type, file_type, is_test, is_declaration, is_backend, is_frontend)``."""
    backend = names_segment(path, BACKEND)
    frontend = ext.isin(".jsx", ".tsx") | names_segment(path, FRONTEND)
    context = F.when(backend & ~frontend, "backend").when(frontend & ~backend, "frontend").otherwise("isomorphic")
    declaration = path.endswith(".d.ts")
    kind = F.when(declaration, "declaration").when(names_segment(path, CONFIG), "config").when(names_segment(path, LOGIC), "logic").otherwise("general")
    is_test = (territory(path) == "test") | _any(path, (".test.", ".spec.", "__tests__/"))
    return F.struct(
        context.alias("context_type"), kind.alias("file_type"), is_test.alias("is_test"), declaration.alias("is_declaration"), backend.alias("is_backend"), frontend.alias("is_frontend")
    )


def role_weight(where: Column) -> Column:
    return F.when(where.isin("vendor", "dist", "node_modules"), 0.1).when(where == "test", 0.5).when(where == "config", 0.6).otherwise(1.0)


def line_count(size: Column, average: Column) -> Column:
    """Estimated lines of a file; without an average the size itself, and 100 for an empty file."""
    return F.when(average > 0, F.greatest(F.floor(size / F.nullif(average, F.lit(0.0)) + 0.5), F.lit(1))).otherwise(F.greatest(F.coalesce(F.nullif(size, F.lit(0)), F.lit(100)), F.lit(1))).cast("bigint")


def clamp(score: Column) -> Column:
    return F.when(score < 0, 0.0).when(score > 100, 100.0).otherwise(F.floor(score * 10 + 0.5) / 10)


def verdict(score: Column) -> Column:
    return (
        F.when(score <= 0, "Clean").when(score <= 10, "Minimal").when(score <= 25, "Some issues").when(score <= 50, "Concerning").when(score <= 75, "Heavy").otherwise("Critical")
    )


def verdict_label(word: Column) -> Column:
    shown = {"Clean": "CLEAN", "Minimal": "MINIMAL", "Some issues": "SOME ISSUES", "Concerning": "NOTICEABLE", "Heavy": "HEAVY", "Critical": "CATASTROPHIC"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shown.items() for x in kv]), word), F.upper(word))


def score_color(score: Column) -> Column:
    """Colour a score is shown in; none for low ones."""
    return F.when(score <= 10, "").when(score <= 50, "yellow").otherwise("red")


def axis_of(category: Column) -> Column:
    """The axis a category is shown under."""
    b = ("security", "config-exposure", "dependency")
    c = ("error-handling", "async-abuse", "structure-smell", "complexity-spike", "magic-values", "import-hygiene", "promise-graveyard")
    return F.when(category.isin(*b), "B").when(category.isin(*c), "C").otherwise("A")


def signal_label(value: Column) -> Column:
    return F.when(value.isNull(), "?").when(value < 0.33, "low").when(value < 0.66, "medium").otherwise("high")


def calibration_weight(n_files: Column) -> Column:
    return F.when(n_files <= 10, 0.0).when(n_files >= 100, 1.0).otherwise((n_files - 10) / 90.0)


def length_multiplier(n: Column) -> Column:
    return F.when(n >= 12, 1.0).when(n <= 6, 0.0).otherwise((n - 6) / 6.0)
