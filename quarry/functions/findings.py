"""Expressions on findings, seeds and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a seed, allowed transitions, and words for them.
TRANSITIONS = {"Pendiente": ["En revisión", "Resuelta", "Ignorada"], "En revisión": ["Resuelta", "Ignorada"], "Resuelta": [], "Ignorada": []}


def confidence(real: Column, test: Column, comment: Column, dynamic: Column) -> Column:
    """How sure a name is unused, by its occurrences; null if it is used."""
    return F.when(real > 0, F.lit(None).cast("string")).when((test > 0) | (comment > 0), "medio").when(dynamic > 0, "bajo").otherwise("alto")


def suggested_action(sure: Column) -> Column:
    return F.when(sure == "alto", "eliminar").when(sure == "medio", "comentar").when(sure == "bajo", "revisar-manualmente")


def severity_prefix(description: Column) -> Column:
    return F.regexp_extract(description, r"^\[(error|advertencia|recomendación)\]", 1)


def diagnostic_severity(description: Column, sure: Column) -> Column:
    prefix = severity_prefix(description)
    return F.when(prefix == "error", "Error").when(prefix == "advertencia", "Warning").when(prefix == "recomendación", "Information").when(sure == "alto", "Warning").otherwise("Information")


def seed_type(kind: Column, sure: Column) -> Column:
    low = F.lower(kind)
    return F.when(F.contains(low, F.lit("review")), "review").when(F.contains(low, F.lit("tip")), "tip").when(sure.isNotNull(), "problema").otherwise("recomendación")


def clamped_progress(current: Column, total: Column) -> Column:
    share = F.when(total > 0, current / total * 100).otherwise(F.lit(0.0))
    return F.when(F.isnan(share) | share.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)))


def clamped_amount(x: Column) -> Column:
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(usable, F.least(F.lit(1000), F.greatest(F.lit(1), F.floor(x + 0.5)))).otherwise(F.lit(1)).cast("int")


def backoff(failures: Column, start: int = 500, most: int = 10_000) -> Column:
    """Milliseconds to wait after so many failures: doubling from the start to a limit."""
    return F.least(F.lit(most), F.lit(start) * F.pow(F.lit(2.0), F.least(failures, F.lit(30)))).cast("int")


#: Words on the button that leads to a state.
BUTTONS = {"Pendiente": "Marcar pendiente", "En revisión": "Marcar en revisión", "Resuelta": "Resolver", "Ignorada": "Ignorar"}


def buttons(state: Column) -> Column:
    """Buttons for the states that may follow, in order: structs of label and state."""
    result = F.lit(None).cast("array<struct<label: string, state: string>>")
    for now, following in TRANSITIONS.items():
        listed = F.array(*[F.struct(F.lit(BUTTONS[s]).alias("label"), F.lit(s).alias("state")) for s in following]) if following else F.array()
        result = F.when(state == now, listed.cast("array<struct<label: string, state: string>>")).otherwise(result)
    return result


def transition_error(seed_id: Column, known: Column, state: Column, to: Column) -> Column:
    """Why a change of state is refused; null if it is allowed."""
    table = {s: ", ".join(n) or "(ninguna, estado terminal)" for s, n in TRANSITIONS.items()}
    allowed = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    ok = F.create_map(*[x for s, n in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, n)).cast("array<string>"))])
    refused = F.format_string('Transición inválida para la Semilla "%s": no se puede pasar de "%s" a "%s". Transiciones válidas desde "%s": %s.', seed_id, state, to, state, allowed[state])
    return F.when(~known, F.format_string('No se encontró la Semilla con id "%s".', seed_id)).when(~F.array_contains(ok[state], to), refused)


def seed_detail(kind: Column, description: Column, path: Column, line: Column, action: Column) -> Column:
    """A seed's fields, one a line; those that it lacks are left out."""
    place = F.when(path.isNotNull(), F.concat(F.lit("Ubicación: "), path, F.lit(":"), line.cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("Tipo: "), kind), F.concat(F.lit("Descripción: "), description), place, F.when(action != "", F.concat(F.lit("Acción sugerida: "), action)))


def schema_text(schema: Column) -> Column:
    """A schema's fields with their types, or its type alone if it is no object. Input: struct of type and properties."""
    fields = F.array_join(F.transform(schema["properties"], lambda p: F.concat(p["name"], F.lit(": "), p["type"])), ", ")
    return F.when((schema["type"] == "object") & schema["properties"].isNotNull(), F.concat(F.lit("{ "), fields, F.lit(" }"))).otherwise(schema["type"])


def within_any(x: Column, y: Column, areas: Column) -> Column:
    """Whether a point lies in any rectangle (x, y, width, height), whose far edges don't belong to it."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    inside = F.exists(areas, lambda a: (x >= a["x"]) & (x < a["x"] + a["width"]) & (y >= a["y"]) & (y < a["y"] + a["height"]))
    return F.coalesce(finite(x) & finite(y) & inside, F.lit(False))
