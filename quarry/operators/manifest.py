"""Sections of a README draft and an explanation of a repository, from its manifest and tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports

#: Packages and the words for them, packages of frontends and backends, and stacks that packages tell of.
LABELS = {
    "react": "React (frontend)", "react-dom": "React DOM", "next": "Next.js (frontend)", "vue": "Vue (frontend)", "@angular/core": "Angular (frontend)", "svelte": "Svelte (frontend)",
    "express": "Express (backend)", "koa": "Koa (backend)", "fastify": "Fastify (backend)", "@nestjs/core": "NestJS (backend)", "mongoose": "Mongoose (ORM MongoDB)", "prisma": "Prisma (ORM)",
    "sequelize": "Sequelize (ORM)", "typeorm": "TypeORM (ORM)", "graphql": "GraphQL", "apollo-server": "Apollo Server (GraphQL)", "socket.io": "Socket.IO", "typescript": "TypeScript",
    "vitest": "Vitest (testing)", "jest": "Jest (testing)", "mocha": "Mocha (testing)", "cypress": "Cypress (testing E2E)", "playwright": "Playwright (testing E2E)", "eslint": "ESLint (linting)",
    "webpack": "Webpack (bundler)", "vite": "Vite (bundler)", "tailwindcss": "Tailwind CSS", "bootstrap": "Bootstrap", "styled-components": "styled-components", "redux": "Redux", "mobx": "MobX", "axios": "Axios (cliente HTTP)",
}
#: Places of the sections that are lists of what a repository has.
LISTED = {"env": 4, "tree": 6, "endpoints": 7}
FRONTENDS, BACKENDS = ["react", "next", "vue", "@angular/core", "svelte"], ["express", "koa", "fastify", "@nestjs/core"]
FRONTEND_STACK = {"react": "react", "react-dom": "react", "vue": "vue", "@angular/core": "angular", "svelte": "svelte", "next": "next.js"}
BACKEND_STACK = {"express": "express", "fastify": "fastify", "koa": "koa", "@nestjs/core": "nestjs", "hapi": "hapi"}


def _lookup(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _dependencies() -> Column:
    """Names of a manifest's dependencies, those for development after the others."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(F.map_keys("dependencies"), none), F.coalesce(F.map_keys("devDependencies"), none)))


def summary(names: Column) -> Column:
    """Words for the known packages."""
    known = F.filter(F.transform(names, lambda n: F.try_element_at(_lookup(LABELS), n)), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("sin dependencias reconocidas")


def stack(names: Column, labels: dict[str, str], otherwise: Column) -> Column:
    """Labels of a stack, or the given one if there is none; null if that is null too."""
    found = F.array_distinct(F.filter(F.transform(names, lambda n: F.try_element_at(_lookup(labels), n)), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).when(otherwise.isNotNull(), F.array(otherwise))


def _section(manifest: DataFrame, at: int, title: str, content: Column, reason: str) -> DataFrame:
    return manifest.select(F.lit(at).alias("ord"), F.lit(title).alias("title"), content.alias("content"), F.when(content.isNull(), F.lit(reason)).alias("omitted_reason"))


def _with_cells(one: DataFrame, **cells: DataFrame) -> DataFrame:
    """A row with a column for each table of one row and one column."""
    for name, x in cells.items():
        one = one.withColumn(name, x.scalar())
    return one


def _endpoint_text() -> Column:
    return F.format_string("- **%s** %s (`%s:%d`)", "method", "route", "path", "line")


def _env_text(name: Column) -> Column:
    return F.concat(F.lit("- `"), name, F.lit("`"))


def readme_sections(manifest: DataFrame, files: DataFrame, endpoints: DataFrame, env: DataFrame, manager: str = "npm") -> DataFrame:
    """ord, title, content, omitted_reason of the sections of a draft. ``manifest``: one row, all null without a manifest.

    Contents are one text each, so this is for what a reader can take in; readme_lines() has a row for each line.
    """
    counts = files.agg(F.count(F.lit(1)).alias("n_files"))
    ends = endpoints.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "seq", _endpoint_text().alias("t")))), lambda x: x["t"]), "\n").alias("endpoints"))
    names = env.agg(F.array_join(F.transform(F.sort_array(F.collect_list("name")), _env_text), "\n").alias("env"))
    tree = reports.render_tree(reports.folder_tree(files.select("path"))).withColumnRenamed("text", "tree")
    one = _with_cells(manifest.withColumn("deps", _dependencies()), n_files=counts, endpoints=ends, env=names, tree=tree)
    fenced = F.concat(F.lit("```\n"), "tree", F.lit("\n```"))
    return _sections(one, manager, F.nullif("env", F.lit("")), F.when(F.col("n_files") > 0, fenced), F.nullif("endpoints", F.lit("")))


def readme_lines(manifest: DataFrame, files: DataFrame, endpoints: DataFrame, env: DataFrame, manager: str = "npm") -> DataFrame:
    """The draft line by line: section, title, rank, key, seq, text, omitted_reason; lines are in the order of (section, rank,
    key, seq). Files, endpoints and names stay rows. A section that is left out has one row, with a reason and no text.

    ``seq`` of endpoints orders those of a path; rows without a path come first. Repeated endpoints are lines each.
    """
    counts = {name: rows.agg(F.count(F.lit(1))) for name, rows in (("n_files", files), ("n_ends", endpoints), ("n_env", env))}
    one = _with_cells(manifest.withColumn("deps", _dependencies()), **counts)
    there = lambda name: F.when(F.col(name) > 0, F.lit(""))
    sections = _sections(one, manager, there("n_env"), there("n_files"), there("n_ends"))
    none = F.array().cast("array<string>")
    row = lambda rank, key, at, text: [F.lit(rank).alias("rank"), key.alias("key"), at.cast("long").alias("seq"), text.alias("text")]
    lists = (LISTED["env"], LISTED["tree"], LISTED["endpoints"])
    short = sections.where(~F.col("ord").isin(*lists) | F.col("content").isNull()).select("ord", F.posexplode_outer(F.split("content", "\n", -1)).alias("pos", "line"))
    fence = files.limit(1).select(F.explode(F.array(F.lit(0), F.lit(2))).alias("rank"), none.alias("key"), F.lit(0).cast("long").alias("seq"), F.lit("```").alias("text"))
    parts = [
        short.select("ord", *row(1, none, F.coalesce("pos", F.lit(0)), F.col("line"))),
        env.select(F.lit(lists[0]).alias("ord"), *row(1, F.array("name"), F.lit(0), _env_text(F.col("name")))),
        fence.select(F.lit(lists[1]).alias("ord"), "*"),
        reports.tree_lines(reports.folder_tree(files.select("path"))).select(F.lit(lists[1]).alias("ord"), *row(1, F.col("order"), F.lit(0), F.col("line"))),
        endpoints.select(F.lit(lists[2]).alias("ord"), *row(1, F.array("path"), F.col("seq"), _endpoint_text())),
    ]
    titles = sections.select(F.col("ord").alias("section"), "title", "omitted_reason")
    return titles.join(reduce(DataFrame.unionByName, parts), F.col("section") == F.col("ord")).select("section", "title", "rank", "key", "seq", "text", "omitted_reason")


def write_markdown(lines: DataFrame, path: str, confirm: Callable[[int], bool]) -> bool:
    """Write the lines of a draft as text files, whose names are in the order of the draft, if the number of lines is confirmed;
    tells whether they were. One file is never made of all lines, nor sorted in one task."""
    if not confirm(lines.where("text IS NOT NULL").count()):
        return False
    body = lines.where("text IS NOT NULL").select("section", "rank", "key", "seq", "text")
    none = F.array().cast("array<string>").alias("key")
    heads = lines.where("text IS NOT NULL").select("section", "title").distinct()
    heads = heads.select("section", F.lit(-1).alias("rank"), none, F.posexplode(F.array(F.lit(""), F.concat(F.lit("## "), "title"), F.lit(""))).alias("seq", "text"))
    top = lines.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(-1).alias("rank"), none, F.lit(0).alias("seq"), F.lit("# README (borrador)").alias("text"))
    order = ("section", "rank", "key", "seq")
    body.unionByName(heads).unionByName(top).repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)
    return True


def _sections(one: DataFrame, manager: str, env: Column, tree: Column, endpoints: Column) -> DataFrame:
    has = F.col("name").isNotNull() | F.col("scripts").isNotNull() | F.col("dependencies").isNotNull() | F.col("devDependencies").isNotNull()
    known = F.filter("deps", lambda n: F.map_contains_key(_lookup(LABELS), n))
    other = F.array_except("deps", known)
    rest = F.when(F.size(other) > 0, F.array(F.concat(F.lit("- Otras dependencias: "), F.array_join(other, ", ")))).otherwise(F.array().cast("array<string>"))
    techs = F.concat(F.transform(known, lambda n: F.concat(F.lit("- "), _lookup(LABELS)[n])), rest)
    run = lambda s: F.map_contains_key(F.coalesce("scripts", F.create_map().cast("map<string,string>")), s)
    among = lambda packages: F.arrays_overlap("deps", F.array(*map(F.lit, packages)))
    steps = F.array_compact(F.array(
        F.when(run("dev"), F.concat(F.lit("- Ejecuta `npm run dev` para iniciar "), F.when(among(FRONTENDS), "el servidor de desarrollo del frontend").otherwise("el proyecto en modo desarrollo"), F.lit("."))),
        F.when(run("start"), F.concat(F.lit("- Ejecuta `npm start` para iniciar "), F.when(among(BACKENDS), "el servidor backend").otherwise("la aplicación"), F.lit("."))),
        F.when(run("build"), F.lit("- Ejecuta `npm run build` para generar la build de producción.")),
    ))
    scripts = F.transform(F.map_entries("scripts"), lambda e: F.concat(F.lit("- `npm run "), e["key"], F.lit("`: "), e["value"]))
    about = F.concat(F.coalesce("name", F.lit("Este proyecto")), F.lit("."), F.coalesce(F.concat(F.lit(" "), "description"), F.lit("")), F.format_string(" Contiene %d archivo(s) indexado(s). Tecnologías detectadas: ", "n_files"), summary(F.col("deps")), F.lit("."))
    text = lambda items: F.when(F.size(items) > 0, F.array_join(items, "\n"))
    fenced = lambda c, kind="": F.concat(F.lit(f"```{kind}\n"), c, F.lit("\n```"))
    sections = [
        ("Descripción del proyecto", F.when(has | (F.col("n_files") > 0), about), "No se encontró información suficiente para generar una descripción (falta package.json y no hay archivos indexados)."),
        ("Stack tecnológico", text(techs), "No se encontró información de dependencias (falta package.json o no declara dependencias)."),
        ("Instalación", F.when(has, fenced(F.lit(f"{manager} install"), "bash")), "No se encontró package.json."),
        ("Variables de entorno", env, "No se detectaron variables de entorno."),
        ("Scripts disponibles", text(scripts), "No se encontraron scripts en package.json."),
        ("Estructura de carpetas", tree, "No se encontraron archivos indexados para construir la estructura de carpetas."),
        ("Endpoints principales", endpoints, "No se detectaron endpoints backend."),
        ("Instrucciones para ejecutar frontend y backend", text(steps), 'No se pudo determinar cómo ejecutar el proyecto (no se detectaron scripts "dev"/"start"/"build" ni frameworks conocidos).'),
    ]
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(t).alias("title"), c.cast("string").alias("content"), F.when(c.isNull(), F.lit(r)).alias("omitted_reason")) for i, (t, c, r) in enumerate(sections, 1)]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def markdown(sections: DataFrame) -> DataFrame:
    """One row, text: the sections that aren't omitted, in order."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("## "), "title", F.lit("\n\n"), "content").alias("t")))), lambda x: x["t"])
    return sections.where("content IS NOT NULL").agg(F.concat(F.lit("# README (borrador)\n\n"), F.array_join(body, "\n\n"), F.lit("\n")).alias("text"))


def explain(manifest: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One row: frontend and backend stacks (null where nothing tells of one) and main dependencies."""
    seen = symbols.agg(F.bool_or(F.col("type") == "component").alias("components")).withColumn("_k", F.lit(1))
    ends = endpoints.agg(F.count(F.lit(1)).alias("n_endpoints")).withColumn("_k", F.lit(1))
    one = manifest.withColumn("deps", _dependencies()).withColumn("_k", F.lit(1)).join(seen, "_k").join(ends, "_k")
    return one.select(
        stack(F.col("deps"), FRONTEND_STACK, F.when(F.col("components"), "componentes de frontend (framework no identificado)")).alias("frontend"),
        stack(F.col("deps"), BACKEND_STACK, F.when(F.col("n_endpoints") > 0, "endpoints de backend (framework no identificado)")).alias("backend"),
        F.coalesce(F.map_keys("dependencies"), F.array().cast("array<string>")).alias("dependencies"),
    )


def same_items(a: Column, b: Column) -> Column:
    """Whether two lists hold the same items, in any order and number; null is empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def empty_manifest(spark: SparkSession) -> DataFrame:
    from ..sources.repository import MANIFEST

    return spark.createDataFrame([(None,) * 5], MANIFEST)


def package_manager(names: Column) -> Column:
    """The package manager that a root folder's file names tell of."""
    return F.when(F.array_contains(names, "pnpm-lock.yaml"), "pnpm").when(F.array_contains(names, "yarn.lock"), "yarn").otherwise("npm")


#: How many endpoints and components tell of the flow; sections of an explanation and why one is left out.
FLOW_ITEMS = 8
PARTS = {"frontend": "Stack de frontend", "backend": "Stack de backend", "dependencies": "Principales dependencias", "flow": "Flujo principal de la aplicación"}
NO_PART = {"frontend": "No se detectó código de frontend.", "backend": "No se detectó código de backend."}
NO_FLOW = "No se pudo generar la descripción del flujo: el modelo no está disponible."


def flow_items(symbols: DataFrame, endpoints: DataFrame, most: int = FLOW_ITEMS) -> DataFrame:
    """kind, text of the first endpoints and the first components, in the order of path and place."""
    first = lambda rows, kind, text: rows.orderBy("path", "seq").limit(most).select(F.lit(kind).alias("kind"), text.alias("text"))
    ends = first(endpoints, "endpoint", F.format_string("%s %s (%s)", "method", "route", "path"))
    return ends.unionByName(first(symbols.where("type = 'component'"), "component", F.format_string("%s (%s)", "name", "path")))


def explanation(manifest: DataFrame, symbols: DataFrame, endpoints: DataFrame, flow: str | None = None) -> DataFrame:
    """One row: explain() with the flow that a model told, whether that failed, and what is left out with the reason.

    Without a flow, or with a blank one, this is the explanation that is left when a model is missing or too late.
    """
    told = (flow or "").strip()
    omitted = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.struct(F.lit(PARTS[k]).alias("title"), F.lit(r).alias("reason"))) for k, r in NO_PART.items()]))
    return explain(manifest, symbols, endpoints).select("*", F.lit(told or NO_FLOW).alias("flow"), F.lit(not told).alias("flow_failed"), omitted.alias("omitted"))


def changed_parts(old: Column, new: Column) -> Column:
    """Titles of the parts in which two explanations (structs) differ; the order of list items doesn't matter."""
    lists = [F.when(~same_items(old[k], new[k]), F.lit(PARTS[k])) for k in ("frontend", "backend", "dependencies")]
    return F.array_compact(F.array(*lists, F.when(~old["flow"].eqNullSafe(new["flow"]), F.lit(PARTS["flow"]))))


def write_draft(draft: str, write: Callable[[str], None], confirm: Callable[[str], bool]) -> bool:
    """Write a draft where it is confirmed; tells whether it was."""
    if not confirm(draft):
        return False
    write(draft)
    return True
