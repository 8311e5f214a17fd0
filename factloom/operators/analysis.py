"""2.16: what can be plugged in. Analyzers over files, model providers, and rounds that ask them, check, retry and fall back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import facts as A
from factloom.operators import reports
from factloom.operators.documents import Project
from factloom.operators.steps import Step

#: Share of claims that may be dropped before a round is asked again, and rows of facts in a fallback.
MOST_DROPPED, EXTENSIONS, DEPS, REMARKS = 0.3, 10, 20, 20

Analyzer = Callable[[DataFrame], DataFrame]  #: files to facts
Estimator = Callable[[str], int]  #: tokens of a text


def tokens_of(text: str) -> int:
    """F1 for text at hand."""
    return -(-len(text.encode("utf-16-le")) // 2 // T.CHARS_PER_TOKEN)


class Provider(Protocol):
    """A model. It gives the JSON of its answer and the tokens in and out."""

    max_context: int

    def complete(self, system: str, user: str, temperature: float, most: int) -> tuple[dict, dict[str, int]]: ...


def analyze(files: DataFrame, analyzers: dict[str, Analyzer]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Facts by analyzer, and of those that fail, why; a failure leaves the others alone. Plans are only built here, so
    failures while they run belong to whoever runs them."""
    made, failed = {}, {}
    for name, run in analyzers.items():
        try:
            made[name] = run(files)
        except Exception as e:  # an analyzer's failure is its result
            failed[name] = f"{type(e).__name__}: {e}"
    return made, failed


#: Analyzers that need nothing but files(path, content).
ANALYZERS: dict[str, Analyzer] = {
    "extensions": lambda files: A.by_extension(files.select(T.extname("path").alias("extension"))), "folders": A.ancestors, "todos": A.todos,
    "lines": lambda files: files.select("path", T.line_count("content").alias("lines")), "hashes": lambda files: files.select("path", T.content_hash("content").alias("hash")),
}


@dataclass
class Round:
    """A question to a model: its data from facts and earlier outcomes, how its claims are checked, and what stands in for it."""

    number: int
    name: str
    needs: tuple[int, ...]
    data: Callable[[Project, dict], str]
    fallback: Callable[[Project], dict]
    check: Callable[[Project, dict], dict[str, int]] = lambda p, answer: {"validated": 0, "corrected": 0, "total": 0}
    system: str = "Answer in JSON from the facts given and from nothing else."
    again: str = "Your last answer was vague or named what does not exist. Name files of the project."
    most: int = 4096


@dataclass
class Result:
    data: dict
    status: str  #: success, retried or degraded
    validation: dict[str, int] = field(default_factory=lambda: {"validated": 0, "corrected": 0, "total": 0})
    usage: dict[str, int] = field(default_factory=dict)
    error: str | None = None


def acceptable(answer: dict, number: int) -> bool:
    """2.13, F33 for an answer at hand."""
    text = json.dumps(answer, ensure_ascii=False, separators=(",", ":"))
    length, references = reports.QUALITY.get(number, reports.QUALITY[5])
    return len(text.encode("utf-16-le")) // 2 >= length and len(re.findall(T.REFERENCE, text, re.A)) >= references and re.search(reports.PATH, text, re.A) is not None


def ask(r: Round, p: Project, provider: Provider, prior: dict[int, Result]) -> Result:
    """One more try if too many claims are dropped or the answer is poor, but not a third; the fallback if the model fails."""
    usage: dict[str, int] = {}
    try:
        data = r.data(p, prior)
        for again in (False, True):
            answer, used = provider.complete(f"{r.system} {r.again}" if again else r.system, data, 0.1 if again else 0.3, r.most)
            usage = {k: usage.get(k, 0) + v for k, v in used.items()}
            checked = r.check(p, answer)
            poor = checked["total"] and checked["corrected"] / checked["total"] > MOST_DROPPED or not acceptable(answer, r.number)
            if again or not poor:
                return Result(answer, "retried" if again else "success", checked, usage)
    except Exception as e:  # a model that fails does not stop the others
        return Result(r.fallback(p), "degraded", usage=usage, error=str(e))
    raise AssertionError("not reached")


def steps_of(rounds: list[Round], p: Project, provider: Provider) -> list[Step]:
    """Rounds as steps; each gets the outcomes of those before it."""
    def run(r):
        return lambda done: ask(r, p, provider, {n: done[f"round-{n}"].value for n in r.needs})

    return [Step(f"round-{r.number}", [f"round-{n}" for n in r.needs], run(r)) for r in rounds]


OFF = "not assessed: no model answered"
#: Rows of facts that an answer in place of a model's lists at most; what it says of all of them is counted over all.
LISTED = 1000


def rows_of(df: DataFrame | None, limit: int, *order) -> list:
    return df.orderBy(*order).limit(limit).collect() if df is not None else []


def fallback_1(p: Project) -> dict:
    files, deps = p.facts["files"], p.facts.get("deps")
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).withColumn("size", T.complexity("n")).first()
    kinds = rows_of(A.by_extension(files.select(T.extname("path").alias("extension"))), EXTENSIONS, F.desc("files"), "extension")
    prod = rows_of(deps.filter("type = 'production'").select("name", "seq") if deps is not None else None, DEPS, "seq")
    return {
        "projectName": p.name, "primaryLanguage": kinds[0]["extension"] if kinds else "unknown", "purpose": OFF, "technicalLandscape": f"{total['n']} files of {total['lines']} lines; " + ", ".join(f"{k['extension']} ({k['files']})" for k in kinds),
        "keyDependencies": [{"name": d["name"], "role": "production"} for d in prod], "entryPoints": [], "projectScale": {"fileCount": total["n"], "estimatedComplexity": total["size"], "mainConcerns": []},
        "techDebt": [f"{t['marker']} in {t['path']}:{t['line']}: {t['text']}" for t in rows_of(p.facts.get("todos"), REMARKS, "seq")], "findings": ["Counts of what was scanned, without a model's reading of it"], "openQuestions": [],
    }


def fallback_2(p: Project) -> dict:
    """Folders of the first level as modules, the first LISTED of them, each with the first LISTED files below it."""
    below = p.facts["files"].filter(F.contains("path", F.lit("/")) & ~F.startswith("path", F.lit("."))).select(T.top_dir("path").alias("dir"), "path")
    first = below.withColumn("k", F.row_number().over(Window.partitionBy("dir").orderBy("path"))).filter(F.col("k") <= LISTED)
    top = first.groupBy("dir").agg(F.sort_array(F.collect_list("path")).alias("files"))
    modules = [{"name": r["dir"], "path": r["dir"], "purpose": OFF, "publicApi": [], "files": r["files"]} for r in rows_of(top, LISTED, "dir")]
    return {"modules": modules, "relationships": [], "boundaryIssues": ["Folders of the first level stand in for modules"], "findings": [], "openQuestions": []}


def fallback_3(p: Project) -> dict:
    return {"features": [], "crossModuleFlows": [], "findings": ["Features are not told by facts alone"]}


def fallback_4(p: Project) -> dict:
    return {"patterns": [], "dataFlow": [], "findings": ["Patterns are not told by facts alone"]}


def fallback_5(p: Project) -> dict:
    """Remarks as edge cases: the first of the first folders, where they stand and with their markers."""
    from factloom.operators import rounds

    todos, none = p.facts.get("todos"), {"strategy": OFF, "gaps": [], "patterns": []}
    found = rows_of(rounds.remarks_by_folder(todos) if todos is not None else None, rounds.FOLDERS, "first")
    case = lambda r: {"description": r["text"], "file": r["path"], "line": r["line"], "severity": "info", "evidence": f"{r['marker']}: {r['text']}"}
    return {"modules": [{"moduleName": r["folder"], "edgeCases": [case(x) for x in r["remarks_listed"]], "conventions": [], "errorHandling": none} for r in found], "crossCuttingConventions": [], "findings": ["Edge cases are the remarks that the code holds"]}


def fallback_6(p: Project) -> dict:
    """What names of files tell of deployment, over all files; of providers the one of the last path. Variables come from env
    files, commands are told by naming the manifests that hold them."""
    ci, env, deps = reports.ci_files(p.facts["files"]), p.facts.get("env_files"), p.facts.get("deps")
    said = ci.agg(F.max_by("provider", F.when(F.col("provider").isNotNull(), F.col("path"))).alias("provider"), F.coalesce(F.bool_or(F.rlike("path", F.lit(f"(?i){reports.CONTAINERS}"))), F.lit(False)).alias("docker")).first()
    variables = rows_of(env.select("path", F.posexplode("variables").alias("i", "name")) if env is not None else None, LISTED, "path", "i")
    built = deps.filter(F.col("manager").isin("npm", "yarn", "pnpm") | (T.basename("path") == "package.json")).select("path").distinct() if deps is not None else None
    return {
        "deployment": {"platform": None, "ciProvider": said["provider"], "containerized": said["docker"], "evidence": [f"file {r['path']}" for r in rows_of(ci, LISTED, "path")] or ["no file of a known CI system or container"]},
        "envVars": [{"name": v["name"], "purpose": OFF, "required": True, "source": v["path"]} for v in variables], "buildProcess": {"commands": [f"scripts of {r['path']}" for r in rows_of(built, LISTED, "path")], "artifacts": [], "scripts": {}},
        "infrastructure": [], "findings": ["Deployment as far as names of files tell it"],
    }


FALLBACKS: dict[int, Callable[[Project], dict[str, Any]]] = {1: fallback_1, 2: fallback_2, 3: fallback_3, 4: fallback_4, 5: fallback_5, 6: fallback_6}
