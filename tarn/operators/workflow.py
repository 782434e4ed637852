"""The diagnosis workflow over tables of runs: each step takes every unfinished run one node further.

understanding, retrieval, generation, validation, then generation once more for the sections that failed, or persistence. A
run is its events, an append-only table of (run_id, step, node, state, parent_run, at); the state is a struct, so a run may be
looked at, resumed or branched at any step. Models are column functions: ``llm(section, messages)`` returns a struct of raw,
done_reason and eval_count, so that what a call costs comes back with its answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import fixed_values as V
from tarn.functions import rules as R
from tarn.operators import reports, runs
from tarn.operators.corpus_qa import latest

_CHUNK = "array<struct<rank:int,source:string,title:string,chapter_title:string,section_title:string,content:string,score:double>>"
_SECTIONS = "array<struct<section:string,raw:string,content:string,source_items:array<int>,done_reason:string,eval_count:int,initial_parse_success:boolean,final_parse_success:boolean,recovery_attempted:boolean,recovery_success:boolean>>"
STATE = {
    "description": "string", "problem_types": "array<string>", "other_problem_type": "string", "retrieval_query": "string", "valid": "boolean", "errors": "array<string>",
    "retrieved": _CHUNK, "top_score": "double", "sections": _SECTIONS, "passed": "boolean", "issues": "array<string>", "failed": "array<string>", "revision_count": "int",
}
EVENTS = f"run_id string, step int, node string, state struct<{','.join(f'{k}:{t}' for k, t in STATE.items())}>, parent_run string, at timestamp"
#: Nodes that a run can pass at most: three, two for each writing of the report, and persistence.
MOST_STEPS = 3 + 2 * (runs.MAX_REVISIONS + 1) + 1
#: What each section is to say, and the sections it reads.
TASKS = {
    "core_diagnosis": ("Name the main management problem of the case in a few sentences.", []),
    "management_concepts": ("Explain the two or three concepts that the diagnosis rests on and what each one shows here.", ["core_diagnosis"]),
    "root_causes": ("Say what leads to the diagnosed problem, step by step.", ["core_diagnosis"]),
    "recommendations": ("Propose at least three actions, each against one of the causes.", ["core_diagnosis", "root_causes"]),
}
_RULES = 'You write one section of a management report from the description and the numbered knowledge only. Answer with one JSON object, {"sentences": [{"text": "...", "source_items": [1]}]}, and nothing else.'


# --- prompts and their sizes ---------------------------------------------------------------------------------------


def section_messages(section: str, description: Column, problem_types: Column, context: Column, earlier: dict[str, Column]) -> Column:
    """array<struct<role, content>>: the rules and the section's task, then the case as JSON with the earlier sections it reads."""
    task, reads = TASKS[section]
    said = [F.lit(section).alias("section"), description.alias("description"), problem_types.alias("problem_types"), context.alias("retrieved_knowledge"), *[earlier[s].alias(s) for s in reads if s in earlier]]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(f"{_RULES}\n\n{task}")), message("user", F.to_json(F.struct(*said))))


def message_sizes(messages: Column) -> Column:
    """struct(message_count, total_chars, chars) of messages."""
    chars = F.transform(messages, lambda m: F.length(F.coalesce(m["content"], F.lit(""))))
    return F.struct(F.size(messages).alias("message_count"), F.aggregate(chars, F.lit(0), lambda a, n: a + n).alias("total_chars"), chars.alias("chars"))


def serialized_chars(value: Column) -> Column:
    """Characters of a value as JSON; a null value has none."""
    return F.when(value.isNull(), 0).otherwise(F.length(F.to_json(F.struct(value.alias("v")))) - len('{"v":}'))


# --- node bodies: states (run_id, *STATE) to states -------------------------------------------------------------------


def understanding(states: DataFrame) -> DataFrame:
    n = R.normalize_intake(F.col("problem_types"), F.col("description"), F.col("other_problem_type"))
    rows = states.withColumn("__n", n)
    taken = {c: F.col(f"__n.{c}") for c in ("description", "problem_types", "other_problem_type", "retrieval_query", "valid", "errors")}
    return rows.withColumns(taken).drop("__n")


def retrieval(states: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``retrieve`` maps (run_id, query) to (run_id, rank, source, title, chapter_title, section_title, content, score)."""
    found = retrieve(states.select("run_id", F.col("retrieval_query").alias("query")))
    each = F.struct("rank", "source", "title", "chapter_title", "section_title", "content", "score")
    lists = found.groupBy("run_id").agg(F.array_sort(F.collect_list(each)).cast(_CHUNK).alias("retrieved"), F.max("score").cast("double").alias("top_score"))  # the results of one run
    rows = states.drop("retrieved", "top_score").join(lists, "run_id", "left")
    return rows.withColumns({"retrieved": F.coalesce("retrieved", F.array().cast(_CHUNK)), "top_score": F.coalesce("top_score", F.lit(0.0))})


def generation(states: DataFrame, llm: Callable[[Column, Column], Column]) -> DataFrame:
    """Write the sections that failed, or all, one pass for each level of those that read others; others stay as they are.

    Text that isn't the exact contract is recovered; each section keeps how it was parsed.
    """
    again = F.size(F.coalesce("failed", F.array().cast("array<string>"))) > 0
    rows = states.withColumn("__again", again).withColumn("__context", R.retrieved_context(F.col("retrieved")))
    kept = lambda name: F.get(F.filter("sections", lambda s: s["section"] == name), F.lit(0))
    schema = _SECTIONS.removeprefix("array<").removesuffix(">")
    earlier: dict[str, Column] = {}
    for section in V.SECTIONS:
        wanted = ~F.col("__again") | F.array_contains("failed", section)
        messages = section_messages(section, F.col("description"), F.col("problem_types"), F.col("__context"), earlier)
        rows = rows.withColumn("__said", F.when(wanted, llm(F.lit(section), messages)))
        parsed = reports.parse_sections(rows.withColumn("__raw", F.col("__said.raw")), "__raw")
        metrics = ("initial_parse_success", "final_parse_success", "recovery_attempted", "recovery_success")
        made = F.struct(
            F.lit(section).alias("section"), F.col("__raw").alias("raw"), "content", "source_items", F.col("__said.done_reason").cast("string").alias("done_reason"),
            F.col("__said.eval_count").cast("int").alias("eval_count"), *metrics,
        ).cast(schema)
        rows = parsed.withColumn(f"__{section}", F.when(wanted, made).otherwise(kept(section))).select(*rows.drop("__said").columns, f"__{section}")
        earlier[section] = F.col(f"__{section}.content")
    written = F.filter(F.array(*[F.col(f"__{s}") for s in V.SECTIONS]), lambda s: s.isNotNull())
    count = F.coalesce("revision_count", F.lit(0)) + F.col("__again").cast("int")
    return rows.withColumns({"sections": written.cast(_SECTIONS), "revision_count": count}).select(*states.columns)


def validation(states: DataFrame) -> DataFrame:
    each = states.select("run_id", F.explode("sections").alias("s")).select("run_id", "s.*")
    done = reports.validate_report(states.select("run_id", F.size("retrieved").alias("n_retrieved")), each)
    done = done.select("run_id", "passed", "issues", F.col("failed_sections").alias("failed"))
    return states.drop("passed", "issues", "failed").join(done, "run_id")


def record(states: DataFrame) -> DataFrame:
    """(project_id, created_at, company_context, goal, retrieved_sources, verification, revision_count, final_answer): what is stored of a run."""
    sources = F.transform("retrieved", lambda c: F.struct(c["source"].alias("source"), c["title"].alias("title"), c["score"].alias("score")))
    answer = F.get(F.filter("sections", lambda s: s["section"] == "core_diagnosis"), F.lit(0))["content"]
    verification = F.to_json(F.struct("passed", "issues", "failed"))
    return states.select(
        F.col("run_id").alias("project_id"), F.current_timestamp().alias("created_at"), F.col("description").alias("company_context"), F.lit(None).cast("string").alias("goal"),
        F.to_json(sources).alias("retrieved_sources"), verification.alias("verification"), F.coalesce("revision_count", F.lit(0)).alias("revision_count"), F.coalesce(answer, F.lit("")).alias("final_answer"),
    )


# --- runs -------------------------------------------------------------------------------------------------------------


class Workflow:
    """Runs whose events and records are tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str, retrieve: Callable[[DataFrame], DataFrame], llm: Callable[[Column, Column], Column]):
        self.spark, self.path, self.retrieve, self.llm = spark, path.rstrip("/"), retrieve, llm

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/events")

    def records(self) -> DataFrame:
        """The latest record of each project: an upsert by key, as an append and a choice of the newest."""
        return latest(self.spark.read.parquet(f"{self.path}/records"), "project_id", "created_at", "final_answer", "verification")

    def _append(self, states: DataFrame, node: str, step: Column, parent: Column) -> None:
        state = F.struct(*[(F.col(k) if k in states.columns else F.lit(None)).cast(t).alias(k) for k, t in STATE.items()])
        rows = states.select("run_id", step.cast("int").alias("step"), F.lit(node).alias("node"), state.alias("state"), parent.cast("string").alias("parent_run"), F.current_timestamp().alias("at"))
        rows.write.mode("append").parquet(f"{self.path}/events")

    def start(self, requests: DataFrame) -> None:
        """Begin runs (run_id, description, problem_types, other_problem_type): their first node is done then."""
        states = requests.select("run_id", "description", "problem_types", "other_problem_type", F.lit(0).alias("revision_count"))
        self._append(understanding(states), "understanding", F.lit(0), F.lit(None))

    def pending(self) -> DataFrame:
        """(run_id, step, node, state, parent_run, at, next): the latest events of runs that aren't at their end."""
        s = F.col("state")
        here = runs.current(self.events())
        return here.withColumn("next", runs.next_node(F.col("node"), s["valid"], s["passed"], F.coalesce(s["revision_count"], F.lit(0)) + 1)).filter("next is not null")

    def step(self) -> int:
        """Take each unfinished run through its next node; how many there were."""
        here = self.pending().select("run_id", "step", "parent_run", "next", "state.*").cache()
        counts = {r["next"]: r["count"] for r in here.groupBy("next").count().collect()}  # a row for each node
        bodies = {"retrieval": lambda s: retrieval(s, self.retrieve), "generation": lambda s: generation(s, self.llm), "validation": validation, "persistence": self._persisted}
        made = [(node, bodies[node](here.filter(F.col("next") == node).drop("next"))) for node in counts]
        for node, states in made:
            self._append(states, node, F.col("step") + 1, F.col("parent_run"))
        here.unpersist()
        return sum(counts.values())

    def _persisted(self, states: DataFrame) -> DataFrame:
        record(states).write.mode("append").parquet(f"{self.path}/records")
        return states

    def run_all(self) -> None:
        """Step until every run is at its end."""
        for _ in range(MOST_STEPS):
            if not self.step():
                return

    def state(self, run_id: str) -> DataFrame:
        return runs.current(self.events().filter(F.col("run_id") == run_id))

    def history(self, run_id: str) -> DataFrame:
        return runs.history(self.events(), run_id)

    def predecessor(self, run_id: str, step: int) -> DataFrame:
        """The event before a step of a run."""
        return self.history(run_id).filter(F.col("step") < step).limit(1)

    def branch(self, run_id: str, step: int, new_run: str) -> None:
        """A new run that begins as a copy of another one up to a step; the other one stays."""
        made = runs.branch(self.events(), run_id, step, new_run).select("run_id", "step", "node", "state", "parent_run", "at")
        if made.isEmpty():
            raise ValueError(f"run {run_id} has no step up to {step}")
        made.write.mode("append").parquet(f"{self.path}/events")

    def resume(self, run_id: str, step: int, new_run: str) -> None:
        """Do the node of a step again, from the event before it, as a new run, and go on to its end."""
        before = self.predecessor(run_id, step).first()
        if before is None:
            raise ValueError(f"step {step} of run {run_id} has no predecessor")
        self.branch(run_id, before["step"], new_run)
        self.run_all()
