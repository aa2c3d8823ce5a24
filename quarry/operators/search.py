"""Search over symbols (seq, name, ...), which are ordered by seq."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import model_matches

#: Candidates of a ranked search; suggestions, and the shortest word that gives one.
CANDIDATES, SUGGESTIONS, SHORTEST = 8, 5, 3
_SPACES = r"\s+"


def exact(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols whose name contains the query, in any case; none for a blank query."""
    wanted = query.strip().lower()
    return symbols.where(F.contains(F.lower("name"), F.lit(wanted)) if wanted else F.lit(False))


def _words(query: str) -> list[str]:
    return query.strip().lower().split()


def _hits(words: list[str]) -> Column:
    return sum((F.contains(F.lower("name"), F.lit(w)).cast("int") for w in words), F.lit(0))


def ranked(symbols: DataFrame, query: str, most: int = CANDIDATES) -> DataFrame:
    """The symbols whose names contain most of the query's words, repeated words counted again; ties by seq."""
    return symbols.withColumn("score", _hits(_words(query))).where("score > 0").orderBy(F.desc("score"), "seq").limit(most)


def suggestions(symbols: DataFrame, query: str, most: int = SUGGESTIONS) -> DataFrame:
    """Names, earliest first, that contain a word of the query or lie in one."""
    words = [w for w in _words(query) if len(w) >= SHORTEST]
    name = F.lower("name")
    near = [F.contains(name, F.lit(w)) | F.contains(F.lit(w), name) for w in words]
    found = symbols.where(sum((x.cast("int") for x in near), F.lit(0)) > 0)
    return found.groupBy("name").agg(F.min("seq").alias("first_seq")).orderBy("first_seq").limit(most)


class Model(Protocol):
    """A language model; none is part of the library."""

    def available(self) -> bool: ...

    def query(self, prompt: str) -> str: ...


#: Lines of the prompt.
_PROMPT = (
    "Eres un asistente que ayuda a encontrar código relevante en un repositorio.",
    'Consulta del usuario: "%s"',
    "A continuación se listan símbolos candidatos con su código:",
    "Responde ÚNICAMENTE con un array JSON (sin texto adicional) de objetos con la forma:",
    '[{ "symbolName": string, "filePath": string, "explanation": string }]',
    "Incluye solo los símbolos realmente relevantes para la consulta, generando una breve explicación en español para cada uno. Si ninguno es relevante, responde con [].",
)


def prompt(candidates: DataFrame, query: str) -> DataFrame:
    """One row, prompt: the candidates (at, name, path, type, snippet), as many as ranked() gives, and what is asked."""
    item = F.concat(F.format_string('%d. symbolName: "%s", filePath: "%s", type: "%s"\n', F.col("at") + 1, "name", "path", "type"), "snippet")
    listed = candidates.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("t")))), lambda x: x["t"]), "\n\n").alias("c"))
    first, asked, follow, *rest = _PROMPT
    return listed.select(F.concat_ws("\n\n", F.lit(first), F.lit(asked % query), F.lit(follow), "c", *map(F.lit, rest)).alias("prompt"))


def semantic(candidates: DataFrame, query: str, model: Model | None) -> DataFrame | None:
    """at, name, path, explanation of the candidates that a model names; None where it is missing, fails or isn't legible.

    The model is asked by the driver, with the few candidates of ranked(); without any it isn't asked.
    """
    spark = candidates.sparkSession
    if candidates.isEmpty():
        return spark.createDataFrame([], "name string, path string, at int, explanation string")
    try:
        if model is None or not model.available():
            return None
        answer = model.query(prompt(candidates, query).first().prompt)
    except Exception:  # whatever a model's client raises means the exact search
        return None
    bare = answer.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    try:
        if not isinstance(json.loads(bare), list):
            return None
    except ValueError:
        return None
    return model_matches(spark.createDataFrame([(bare,)], "output string"), candidates)
