"""Expressions on events and actions that go over the wire as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .findings import clamped_amount, clamped_progress

#: Kinds of events and actions, the longest text, and what stands for an empty one.
EVENTS = ["idle", "indexing", "success", "warning", "error", "seed", "hide", "show"]
ACTIONS = ["analyze-repository", "precommit-review", "show-seed-basket", "mute-messages", "hide-mascot", "close-mascot"]
TEXT, NO_TEXT = 2000, "(sin descripción)"
def _field(json: Column, name: str) -> Column:
    """A field's raw JSON, strings with their quotes; null if it is missing."""
    return F.from_json(json, "map<string,string>")[name]


def _kind(json: Column, name: str) -> Column:
    """The JSON type of a field: string, number or other; null if it is missing."""
    raw = F.regexp_extract(json, rf'"{name}"\s*:\s*(.)', 1)
    return F.when(raw == "", F.lit(None)).when(raw == '"', "string").when(raw.rlike(r"[-0-9]"), "number").otherwise("other")


def valid_event(json: Column) -> Column:
    """Whether a JSON text is an event: a known type, the fields that go with it and no others, values within bounds."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    kind = F.when(_kind(json, "type") == "string", _field(json, "type"))
    text = lambda name: (_kind(json, name) == "string") & F.length(_field(json, name)).between(1, TEXT)
    number = lambda name: F.when(_kind(json, name) == "number", _field(json, name).try_cast("double"))
    alone = kind.isin("idle", "hide", "show") & (F.size(keys) == 1)
    file = ~F.array_contains(keys, "file") | text("file")
    progress = ~F.array_contains(keys, "progress") | number("progress").between(0, 100)
    indexing = (kind == "indexing") & (F.size(F.array_except(keys, F.array(*map(F.lit, ("type", "file", "progress"))))) == 0) & file & progress
    message = kind.isin("success", "warning", "error") & (F.size(keys) == 2) & text("message")
    amount = number("amount")
    seed = (kind == "seed") & (F.size(keys) == 2) & (amount == F.floor(amount)) & amount.between(1, 1000)
    return F.coalesce(alone | indexing | message | seed, F.lit(False))


def valid_action(json: Column) -> Column:
    keys = F.json_object_keys(json)
    return F.coalesce((F.size(keys) == 1) & (_kind(json, "action") == "string") & _field(json, "action").isin(ACTIONS), F.lit(False))


def bounded(text: Column) -> Column:
    """At most so many characters; null for an empty text."""
    return F.nullif(F.substring(text, 1, TEXT), F.lit(""))


def message(kind: Column, text: Column) -> Column:
    return F.to_json(F.struct(kind.alias("type"), F.coalesce(bounded(text), F.lit(NO_TEXT)).alias("message")))


def indexing(current: Column, total: Column, file: Column) -> Column:
    return F.to_json(F.struct(F.lit("indexing").alias("type"), bounded(file).alias("file"), clamped_progress(current, total).alias("progress")))


def indexed(n: Column) -> Column:
    return message(F.lit("success"), F.format_string("Indexación completa (%d archivos)", n))


def of_finding(kind: Column, path: Column, description: Column) -> Column:
    secret = kind == "precommit:secret"
    text = F.when(secret, F.concat(F.lit("Se detectó un posible secreto en "), F.coalesce(path, F.lit("archivo desconocido")))).otherwise(description)
    return message(F.when(secret, "error").otherwise("warning"), text)


def of_review(has_errors: Column) -> Column:
    return F.when(has_errors, message(F.lit("warning"), F.lit("Revisión pre-commit con hallazgos"))).otherwise(message(F.lit("success"), F.lit("Revisión pre-commit sin errores")))


def of_seed(amount: Column) -> Column:
    return F.to_json(F.struct(F.lit("seed").alias("type"), clamped_amount(amount).alias("amount")))


def visual_state(kind: Column) -> Column:
    return F.when(kind == "indexing", "working").when(kind == "seed", "success").when(kind == "hide", "sleeping").when(kind.isin("success", "warning", "error"), kind).otherwise("idle")


def bubble(json: Column) -> Column:
    return F.coalesce(_field(json, "message"), _field(json, "file"))


def pending_text(n: Column) -> Column:
    s = F.when(n == 1, "").otherwise("s")
    return F.concat(n.cast("string"), F.lit(" semilla"), s, F.lit(" pendiente"), s)


def of_error(text: Column) -> Column:
    return message(F.lit("error"), text)


def parsed_event(json: Column) -> Column:
    """The fields of a valid event; null for anything else."""
    return F.when(valid_event(json), F.from_json(json, "type string, file string, progress double, message string, amount int"))


def parsed_action(json: Column) -> Column:
    """The action of a valid message; null for anything else."""
    return F.when(valid_action(json), _field(json, "action"))


def effect(action: Column) -> Column:
    """What an action does: runs a command, only leaves a log line, hides or stops."""
    commands = {"analyze-repository": "explain", "precommit-review": "review", "show-seed-basket": "focus-basket", "mute-messages": "log", "hide-mascot": "hide", "close-mascot": "stop"}
    return F.create_map(*[F.lit(x) for kv in commands.items() for x in kv])[action]


def translated(kind: Column, payload: Column) -> Column:
    """The wire event of an event on the bus; null for kinds that aren't passed on. A payload that lacks a field gives an error."""
    at = lambda name: F.get_json_object(payload, f"$.{name}")
    number = lambda name: at(name).try_cast("double")
    finding = of_finding(at("type"), at("filePath"), at("description"))
    made = (
        F.when(kind == "indexing:started", indexing(F.lit(0), F.lit(0), F.lit("")))
        .when(kind == "indexing:progress", F.when(number("current").isNotNull() & number("total").isNotNull(), indexing(number("current"), number("total"), at("currentFile"))))
        .when(kind == "indexing:completed", F.when(number("filesIndexed").isNotNull(), indexed(number("filesIndexed").cast("long"))))
        .when(kind == "analysis:finding", F.when(at("type").isNotNull(), finding))
        .when(kind == "precommit:completed", F.when(at("hasErrors").isNotNull(), of_review(at("hasErrors") == "true")))
        .when(kind == "seed:created", of_seed(F.lit(1.0)))
    )
    known = kind.isin("indexing:started", "indexing:progress", "indexing:completed", "analysis:finding", "precommit:completed", "seed:created")
    return F.when(known, F.coalesce(made, of_error(F.lit("evento sin datos"))))


def progress_text(current: Column, total: Column, file: Column) -> Column:
    return F.format_string("indexando %d/%d (%s)", current, total, file)
