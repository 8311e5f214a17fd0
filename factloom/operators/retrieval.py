"""Vector search: routes and compatibility of an index, nearest chunks, evidence, citations and answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Least relevance of the best and second match, sources, gap, distance of a weak match.
TOP, SECOND, SOURCES, GAP, FAR = 58, 45, 2, 18, 0.65


#: Kinds of documents that a search may ask for; how many matches an answer is built from and how many of a
#: tool's results carry their content.
DOC_TYPES = (
    "project-overview", "getting-started", "architecture", "file-structure", "features", "modules", "dependencies", "environment", "edge-cases-and-gotchas", "tech-debt-and-todos", "conventions", "testing-strategy", "deployment",
)
QA_K, SEARCH_K, WITH_CONTENT = 8, 10, 3


#: Queries and chunks that a task of a search compares.
TILE = 4096, 16384


class SearchError(ValueError):
    """A search that cannot run; code says why."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


def check_index(stored: tuple[str, int] | None, model: str, dims: int, writing: bool = False) -> None:
    """V3: an index (model, dimensions) serves searches of the same model and dimensions only; it may be written under another
    name of a model of the same dimensions. No index fits all."""
    if stored and (stored[1] != dims or stored[0] != model and not writing):
        raise SearchError("SEARCH_EMBEDDING_MISMATCH", f"the index holds {stored[0]} ({stored[1]}D), not {model} ({dims}D)")


def dimensions(configured: int, stored: tuple[str, int] | None, model: str, probe=None) -> int:
    """V4: as configured; else as stored for the same model; else, when writing, as probe() finds."""
    found = configured if configured > 0 else stored[1] if stored and stored[0] == model else probe() if probe else 0
    if not found or found <= 0:
        raise SearchError("SEARCH_EMBEDDING_DIMENSIONS_UNKNOWN" if probe is None else "EMBEDDING_DIMENSIONS_UNKNOWN", f"nothing tells the dimensions of {model}")
    return found


def route(mode: str, remote, local=None, health=None, interactive: bool = False, confirm=None) -> tuple[object, str]:
    """V5: the embedder to use and its kind, 'remote' or 'local'. health(local) is None if it is ready, else what is wrong;
    confirm(problem) lets a person accept the remote one instead."""
    if mode == "remote-only":
        return remote, "remote"
    if local is None:
        raise SearchError("EMBEDDING_LOCAL_PROVIDER_MISSING", f"mode {mode} needs a local embedder")
    problem = health(local) if health else None
    if problem is None:
        return local, "local"
    if mode == "local-only":
        raise SearchError("EMBEDDING_LOCAL_UNAVAILABLE", problem)
    if not interactive:
        raise SearchError("EMBEDDING_CONFIRMATION_REQUIRED", problem)
    if confirm is None:
        raise SearchError("EMBEDDING_CONFIRMATION_HANDLER_MISSING", problem)
    if not confirm(problem):
        raise SearchError("EMBEDDING_FALLBACK_DECLINED", problem)
    return remote, "remote"


def type_filters(types, known: tuple = DOC_TYPES) -> list[str]:
    """The types asked for, in lower case and each once; empty and unknown ones are errors."""
    asked = [t.strip().lower() for t in types or ()]
    for t in asked:
        if t not in known:
            raise SearchError("SEARCH_INVALID_TYPE" if not t else "SEARCH_UNKNOWN_TYPE", f"{t!r} is none of {', '.join(known)}")
    return list(dict.fromkeys(asked))


def search(chunks: DataFrame, query: str, embed, k: int | None = None, types=None, known: tuple = DOC_TYPES) -> tuple[DataFrame, dict]:
    """V6, V7: the nearest chunks with their relevance and rank, and (query, k, types, indexed chunks and types, whether even
    the nearest is far). embed(text) gives the query's vector and is asked only if anything is indexed."""
    query = query.strip()
    if not query:
        raise SearchError("SEARCH_EMPTY_QUERY", "a query needs text")
    k, types = SEARCH_K if k is None else k, type_filters(types, known)
    if not isinstance(k, int) or k < 1:
        raise SearchError("SEARCH_INVALID_TOP_K", "k must be a positive integer")
    stats = chunks.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("doc_type")).alias("types")).first()  # one row
    vector = embed(query) if stats["n"] else []
    found = knn(chunks, vector, k, types or None).withColumn("relevance", T.relevance("distance"))
    found = found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "source_file", "chunk_index")))  # k rows
    top = found.agg(F.min("distance")).first()[0]
    return found, {"query": query, "k": k, "types": types, "indexed": stats["n"], "available": stats["types"], "far": top is not None and top > FAR}


def tool_results(matches: DataFrame, by: tuple = ()) -> DataFrame:
    """What a tool shows of matches (of a query); contents of the first few only."""
    content = F.when(F.col("rank") <= WITH_CONTENT, F.col("content")).alias("content")
    return matches.select(*by, "rank", "relevance", F.col("source_file").alias("source"), F.col("section_path").alias("section"), F.col("content_preview").alias("snippet"), "doc_type", content)


def prompt_context(matches: DataFrame, by: tuple = ()) -> DataFrame:
    """Matches in their order as a prompt's text, one row or one of each query; at most k rows of a query are gathered."""
    part = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("]\nsource_file: "), "source_file", F.lit("\nsection_path: "), "section_path", F.lit("\nchunk_index: "), F.col("chunk_index").cast("string"),
        F.lit("\nrelevance: "), F.format_string("%.2f%%", F.col("relevance").cast("double")), F.lit("\ncontent:\n"), T.unicode_trim("content"), F.lit("\n"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    return matches.groupBy(*by).agg(T.unicode_trim(F.array_join(listed, "\n")).alias("context"))


def answers(matches: DataFrame, by: tuple = (), name: str = "query") -> DataFrame:
    """V9: for each query either its prompt's context and citations, to answer from, or the question back that its weak
    evidence calls for; name: the column that holds the query's text. Queries without matches are not among matches: they
    are clarified by evidence() of none."""
    gate, context = evidence(matches, by), prompt_context(matches, by)
    cited = citations(matches, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_file", "section_path", "chunk_index"))), lambda c: F.struct(c["source_file"].alias("source_file"), c["section_path"].alias("section_path"), c["chunk_index"].alias("chunk_index"))).alias("citations"))
    both = gate.join(context, list(by)).join(cited, list(by)) if by else gate.crossJoin(context).crossJoin(cited)  # one row each
    ask = F.concat(F.lit('Before "'), F.col(name) if name in by else F.lit(name), F.lit('" can be answered: '), F.array_join("reasons", " "), F.lit(" Name a module, a command or a file to look at."))
    return both.select(*by, F.when(F.col("weak"), "clarification").otherwise("answer").alias("kind"), F.when(F.col("weak"), ask).alias("question"), F.when(~F.col("weak"), F.col("context")).alias("context"), "citations")


def knn(chunks: DataFrame, query: list[float], k: int, types: list | None = None, order: tuple = ("source_file", "chunk_index"), type_col: str = "doc_type", distance=T.l2_distance) -> DataFrame:
    """The k nearest among the given types, filtered before they are ranked.

    Only the order's columns and the distance are sorted; the caller joins contents to the k rows.
    """
    if not isinstance(k, int) or k < 1:
        raise ValueError("SEARCH_INVALID_TOP_K: k must be a positive integer")
    if types is not None:
        chunks = chunks.filter(F.col(type_col).isin(*types))
    vector = F.array(*(F.lit(float(x)) for x in query))
    return chunks.withColumn("distance", distance("embedding", vector)).orderBy("distance", *order).limit(k)


def nearest(x, y, bad, k: int, rows: int = 512):
    """Per row of y the k nearest rows of x, as (row of y, row of x, distance); bad rows of x come last, equal ones in x's order.

    A matrix product gives all distances but for its rounding; pairs that it does not rule out are computed again."""
    small = np.abs(x[~bad]).max(initial=0) < 1e100 and np.abs(y).max(initial=0) < 1e100  # neither NaN nor near an overflow
    xx, eps = (x * x).sum(1) if small else None, np.finfo(np.float64).eps
    for begin in range(0, len(y), rows):
        part = y[begin : begin + rows]
        if small and k < len(x):
            yy = (part * part).sum(1)
            d = yy[:, None] + xx - 2 * (part @ x.T)
            d[:, bad] = np.inf
            slack = 16 * (x.shape[1] + 8) * eps * (yy + xx[~bad].max(initial=0))
            i, at = np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        else:
            i, at = (f.reshape(-1) for f in np.indices((len(part), len(x))))
        d = np.zeros(len(i))
        for j in range(x.shape[1]):  # the order in which l2_distance adds up, so that both agree to the last bit
            d += (part[i, j] - x[at, j]) ** 2
        d = np.sqrt(d)
        d[bad[at]] = np.nan
        order = np.lexsort((at, d, bad[at], i))
        i, at, d = i[order], at[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[first] + begin, at[first], d[first]


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int, key: str, id_col: str) -> DataFrame:
    """V1 for many queries (key, vector): blocks of queries meet blocks of chunks, and each two blocks give k rows of each
    query, of which a task passes on k. Vectors that are null, hold a null or differ in length from the query have no
    distance and come last. There are as many tasks as chunks times queries need, 16,384 by 4,096 each; nothing is broadcast."""
    groups, shares = (max(1, -(-df.count() // n)) for df, n in ((queries, TILE[0]), (chunks, TILE[1])))
    types = {"key": dict(queries.dtypes)[key], "id": dict(chunks.dtypes)[id_col]}

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns], names=["ids", "x"])

    def packed(df, kind, a, b):
        rows = df.mapInArrow(pack, f"ids array<{kind}>, x array<array<double>>")
        return rows.select(F.col("ids").alias(a), F.col("x").alias(b))

    def matrix(x, dim: int):
        """Vectors of that length as rows, and which rows are not such vectors."""
        if isinstance(x, pa.Array):
            if x.null_count == 0 and pc.all(pc.equal(pc.list_value_length(x), dim)).as_py() and x.flatten().null_count == 0:
                return x.flatten().to_numpy().reshape(len(x), dim), np.zeros(len(x), bool)
            x = x.to_pylist()
        bad = np.array([v is None or len(v) != dim or None in v for v in x])
        return np.array([[0.0] * dim if w else v for v, w in zip(x, bad, strict=True)], np.float64).reshape(len(x), dim), bad

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, keys = batch.column(0)[r].values, batch.column(2)[r].values
                order = pc.sort_indices(ids, null_placement="at_start")
                ids, x, y = ids.take(order), batch.column(1)[r].values.take(order), batch.column(3)[r].values
                size = pc.fill_null(pc.list_value_length(y), 0).to_numpy()
                for dim in np.unique(size).tolist():
                    of = np.flatnonzero(size == dim)
                    (m, bad), (q, lost) = matrix(x, dim), matrix(y.take(pa.array(of)), dim)
                    for mask, rows in ((bad, np.flatnonzero(~lost)), (np.ones(len(x), bool), np.flatnonzero(lost))):
                        if len(rows):
                            i, at, d = (np.concatenate(f) for f in zip(*nearest(m, q[rows], mask, k), strict=True))
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of[rows][i])), ids.take(pa.array(at)), pa.array(d, mask=mask[at])], names=["key", "id", "distance"])

    c = packed(chunks.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("x")), types["id"], "ids", "x")
    q = packed(queries.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("x")).repartition(groups), types["key"], "keys", "y")
    # each group of queries meets each share of the chunks in a task of its own
    c = c.select("*", F.pmod(F.xxhash64("ids"), F.lit(shares)).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    q = q.select("*", F.spark_partition_id().alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    parts = 2 * groups * shares  # so that few tasks get several tiles
    met = c.repartition(parts, "group", "share").join(q.repartition(parts, "group", "share").hint("merge"), ["group", "share"])
    d = met.select("ids", "x", "keys", "y").mapInArrow(compare, f"key {types['key']}, id {types['id']}, distance double")
    near = d.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("distance"), "id"))).filter(F.col("rank") <= k)
    return near.select(F.col("key").alias(key), F.col("id").alias(id_col), "distance", "rank")


def evidence(matches: DataFrame, by: tuple = ()) -> DataFrame:
    """Whether what was found is too weak to answer from, and why: one row, or one of each query (`by`) that has
    matches. matches(by..., relevance, source_file). A gap of GAP or more before a second match of some relevance means
    conflicting signals, whatever the first one's relevance."""
    a = matches.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("relevance"), asc=False), 1, 2).alias("r"), F.countDistinct("source_file").alias("sources"), F.count("*").alias("n"))
    at = lambda i: F.coalesce(F.get("r", F.lit(i)), F.lit(0.0)).cast("double")
    a = a.select(*by, at(0).alias("top"), at(1).alias("second"), "sources", "n")
    gap = F.greatest(F.lit(0.0), F.col("top") - F.col("second"))
    a = a.withColumn("conflicting", (gap >= GAP) & (F.col("second") > 0))
    why = F.array(
        F.when(F.col("top") < TOP, F.format_string(f"The best match has %.2f%% of the {TOP:.2f}%% that it needs.", "top")), F.when(F.col("second") < SECOND, F.format_string(f"The next match has %.2f%% of the {SECOND:.2f}%% that it needs.", "second")),
        F.when(F.col("sources") < SOURCES, "All matches are of one file."), F.when(F.col("conflicting"), F.format_string("The two best matches lie %.2f%% apart, as if they disagreed.", gap)),
    )
    reasons = F.when(F.col("n") == 0, F.array(F.lit("Nothing in the index matches."))).otherwise(F.filter(why, lambda x: x.isNotNull()))
    return a.withColumn("reasons", reasons).withColumn("weak", F.size("reasons") > 0).drop("n")


def citations(matches: DataFrame, by: tuple = ()) -> DataFrame:
    """One row per file, section and chunk (of a query), the nearest, with its place in reading order."""
    first = matches.groupBy(*by, "source_file", "section_path", "chunk_index").agg(F.min("distance").alias("distance"))
    order = [F.collate("source_file", "UNICODE"), F.collate("section_path", "UNICODE"), "chunk_index"]
    return first.withColumn("place", F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(*order)))


def footnotes(cited: DataFrame) -> DataFrame:
    """The lines below an answer."""
    return cited.select("place", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "source_file", F.lit(" :: "), "section_path", F.lit(" (chunk "), F.col("chunk_index").cast("string"), F.lit(")")).alias("line"))


def sources(matches: DataFrame) -> DataFrame:
    """Distinct files of matches, in order."""
    return matches.filter("source_file != ''").select("source_file").distinct().orderBy(F.collate("source_file", "UNICODE"))


def page(df: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Limit 25 by default, from 1 to 50."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(50, 25 if limit is None else limit)))


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of the same key."""
    return table.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
