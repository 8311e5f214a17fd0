"""What rounds of analysis get to read, how they went, what they cost, and diagrams of what they found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import inside

#: Nodes that a diagram of modules, features and layers shows at most, characters of a configuration and of an
#: infrastructure file that a round reads, and what output costs of the input's tokens.
MODULE_NODES, FEATURE_NODES, LAYER_NODES, CONFIG_CHARS, INFRA_CHARS, OUTPUT_SHARE = 15, 10, 20, 3000, 2000, 0.2
#: Fixed value: milliseconds that running two rounds side by side must save to be told.
TOLD_MS = 2000


def module_files(modules: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """Facts of the files that a module lists; modules(module, files), facts(key, ...)."""
    return modules.select("module", F.explode(F.array_distinct("files")).alias(key)).join(facts, key)


def module_tests(modules: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests below a module's path or with its name anywhere in theirs; modules(module, path, files), tests(path, ...).

    Tests below meet by their folders, names inside paths by an index of grams, for any number of modules.
    """
    named = modules.filter(F.size("files") > 0)
    own = tests.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("at"))
    below = own.filter("at != path").join(named.select("module", F.col("path").alias("at")), "at").select("module", *tests.columns)
    held = inside.holders(named.select(F.col("module").alias("name")), tests.select(F.col("path").alias("text")))
    found = tests.join(held.select(F.col("name").alias("module"), F.col("text").alias("path")), "path").select("module", *tests.columns)
    return below.unionByName(found).distinct()


def config_contents(configs: DataFrame, packed: DataFrame, chars: int = CONFIG_CHARS) -> DataFrame:
    """Each configuration file with the first packed file whose path ends like its path, its content cut to so many
    characters; skipped files have none. configs(file), packed(path, rank, tier, content).

    Files meet the paths that hold them by an index of grams, and then by the end of the path.
    """
    held = inside.holders(configs.select(F.col("file").alias("name")), packed.select(F.col("path").alias("text"))).filter(F.endswith("text", F.col("name")))
    found = held.select(F.col("name").alias("file"), F.col("text").alias("path")).join(packed.select("path", "rank", "tier", "content"), "path")
    first = found.groupBy("file").agg(F.min_by(F.struct("tier", "content"), "rank").alias("f"))
    return configs.join(first, "file", "left").select("file", F.when(F.col("f.tier") != "skip", F.substring("f.content", 1, chars)).alias("content"))


def adjacent(flows: DataFrame) -> DataFrame:
    """(name, place, from, to) of neighbours on paths; flows(name, path)."""
    n = F.size("path")
    pairs = F.arrays_zip(F.slice("path", 1, F.greatest(n - 1, F.lit(0))).alias("from"), F.slice("path", 2, F.greatest(n - 1, F.lit(0))).alias("to"))
    return flows.select("name", F.posexplode(pairs).alias("place", "p")).select("name", "place", F.col("p.from").alias("from"), F.col("p.to").alias("to"))


def failure_counts(rounds: DataFrame) -> DataFrame:
    """One row: rounds that succeeded (retried ones too), degraded ones, skipped ones, and claims; rounds(status,
    validated, corrected) as round_table gives them."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rounds.agg(count("success", "retried").alias("succeeded"), count("degraded").alias("degraded"), count("skipped").alias("skipped"), F.count("*").alias("rounds"), total("validated"), total("corrected"))


def failure_line(counts: DataFrame) -> DataFrame:
    """The counts as a line."""
    some = F.when(F.col("degraded") > 0, F.concat(F.lit(" ("), F.col("degraded").cast("string"), F.lit(" degraded)"))).otherwise("")
    return counts.select(F.concat(F.lit("AI analysis: "), F.col("succeeded").cast("string"), F.lit("/"), F.col("rounds").cast("string"), F.lit(" rounds complete"), some, F.lit(", "), F.col("validated").cast("string"), F.lit(" claims validated, "), F.col("corrected").cast("string"), F.lit(" corrected")).alias("line"))


#: Folders and remarks of each that stand in for edge cases.
FOLDERS, FOLDER_ITEMS = 10, 5


def remarks_by_folder(todos: DataFrame, folders: int = FOLDERS, items: int = FOLDER_ITEMS) -> DataFrame:
    """The first folders of the first level in the order of their first remark, with how many remarks each has and the
    first of them, as texts and whole; todos(path, text, seq), and line and marker where they are known."""
    t = todos.withColumn("folder", T.top_dir("path"))
    top = t.groupBy("folder").agg(F.min("seq").alias("first"), F.count("*").alias("remarks")).orderBy("first", "folder").limit(folders)
    few = t.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("seq"))).filter(F.col("k") <= items)
    fields = ["k", *(c for c in ("text", "path", "line", "marker") if c in todos.columns)]
    listed = few.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("remarks_listed"))
    return top.join(listed, "folder").select("folder", "first", "remarks", F.transform("remarks_listed", lambda x: x["text"]).alias("items"), "remarks_listed")


def dependency_counts(deps: DataFrame) -> DataFrame:
    """Dependencies of each manifest by type; deps(path, type)."""
    count = lambda t: F.count_if(F.col("type") == t).alias(t)
    return deps.groupBy("path").agg(F.count("*").alias("total"), *map(count, ("production", "development", "peer", "optional")))


def repository_tokens(files: DataFrame) -> DataFrame:
    """Files, bytes and a quarter of them as tokens; files(size)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("tokens", F.ceil(F.col("bytes") / T.CHARS_PER_TOKEN))


def cost_estimates(tokens, presets: DataFrame, current: str) -> DataFrame:
    """What a repository would cost with each provider: the current one first, local ones last, then by cost.
    presets(provider, model, local, price_in, price_out); a price that is missing counts 0."""
    t = T.col(tokens).cast("double")
    cost = F.when(F.col("local") | F.col("price_in").isNull(), 0.0).otherwise(t / 1e6 * F.col("price_in") + t * OUTPUT_SHARE / 1e6 * F.col("price_out"))
    out = presets.select("provider", "model", "local", (F.col("provider") == current).alias("current"), cost.alias("cost"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("current"), "local", "cost", "provider")))  # a row for each provider


def cheapest(presets: DataFrame) -> DataFrame:
    """Providers by cost."""
    return presets.orderBy("cost", "provider")


def parallel_savings(rounds: DataFrame, a: int = 5, b: int = 6) -> DataFrame:
    """One row: milliseconds that running rounds a and b side by side saved, null unless both are done and it is worth
    telling; rounds(round, status, ms)."""
    of = lambda n: F.max(F.when((F.col("round") == n) & (F.col("status") == "done"), F.col("ms")))
    return rounds.agg(of(a).alias("a"), of(b).alias("b")).select(F.when(F.least("a", "b") > TOLD_MS, F.col("a") + F.col("b") - F.greatest("a", "b")).alias("saved_ms"))


def cumulative_tokens(rounds: DataFrame) -> DataFrame:
    """Tokens up to each round: of done and cached rounds theirs, of a running one those streamed so far; rounds(round,
    status, tokens, streaming)."""
    own = F.when(F.col("status").isin("done", "cached"), F.col("tokens")).when(F.col("status") == "running", F.col("streaming"))
    return rounds.withColumn("total", F.sum(F.coalesce(own, F.lit(0))).over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each round


def document_status(required, available, generated) -> Column:
    """complete, partial, static-only or not-generated; required and available: arrays of rounds."""
    req, has = T.col(required), T.col(available)
    n = F.size(F.array_intersect(req, has))
    return F.when(~T.col(generated), "not-generated").when(n == F.size(F.array_distinct(req)), "complete").when(n > 0, "partial").otherwise("static-only")


def round_fields(output) -> Column:
    """modules, findings, relationships and open questions of a round's JSON, under any of their names."""
    o = T.col(output)
    text = lambda *names: F.coalesce(*(F.from_json(F.get_json_object(o, f"$.{n}"), "array<string>") for n in names), F.array().cast("array<string>"))
    modules = F.transform(text("modules"), lambda m: F.coalesce(F.get_json_object(m, "$.name"), F.when(~F.startswith(m, F.lit("{")), m)))
    links = F.coalesce(F.from_json(F.get_json_object(o, "$.relationships"), "array<struct<from:string,to:string,type:string>>"), F.array().cast("array<struct<from:string,to:string,type:string>>"))
    links = F.transform(F.filter(links, lambda r: r["from"].isNotNull() & r["to"].isNotNull()), lambda r: F.concat(r["from"], F.lit(" -> "), r["to"], F.when(F.coalesce(r["type"], F.lit("")) != "", F.concat(F.lit(" ("), r["type"], F.lit(")"))).otherwise("")))
    return F.struct(F.filter(modules, lambda m: m.isNotNull()).alias("modules"), text("findings", "keyFindings", "key_findings").alias("findings"), links.alias("relationships"), text("openQuestions", "open_questions").alias("open_questions"))


def diagram(nodes: DataFrame, edges: DataFrame, most: int, head: str, label: str | None = None) -> DataFrame:
    """One row: a diagram of the first nodes and of the edges whose both ends are among them. nodes(name, seq),
    edges(from, to, seq and the label's column). It is a picture, so it holds `most` nodes and their edges."""
    top = nodes.orderBy("seq").limit(most)
    lines = top.select(F.lit(0).alias("part"), "seq", F.concat(F.lit("  "), T.diagram_id("name"), F.lit('["'), "name", F.lit('"]')).alias("line"))
    names = F.broadcast(top.select(T.diagram_id("name").alias("id")).distinct())  # `most` rows
    arrow = F.concat(F.lit(" -->|"), F.col(label), F.lit("| ")) if label else F.lit(" --> ")
    e = edges.withColumns({"a": T.diagram_id("from"), "b": T.diagram_id("to")})
    e = e.join(names.withColumnRenamed("id", "a"), "a", "left_semi").join(names.withColumnRenamed("id", "b"), "b", "left_semi")
    lines = lines.unionByName(e.select(F.lit(1).alias("part"), "seq", F.concat(F.lit("  "), "a", arrow, "b").alias("line")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "line"))), lambda x: x["line"])
    return lines.agg(F.array_join(F.concat(F.array(F.lit("```mermaid"), F.lit(head)), body, F.array(F.lit("```"))), "\n").alias("diagram"))
