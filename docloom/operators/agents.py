"""Agents' steps as rows (run, step, tool, input, observation, log): scratchpads, trajectories, and the loop around a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import stored


def _joined(steps: DataFrame, by: str, order: str, line: Column, separator: str, name: str) -> DataFrame:
    rows = steps.select(by, F.struct(F.col(order).alias("o"), line.alias("t")).alias("x"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), separator).alias(name))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def scratchpad(steps: DataFrame, *, by: str = "run_id", order: str = "step", log: str = "log", observation: str = "observation", shown: str = "Observation: ", ask: str = "Thought: ") -> DataFrame:
    """by and scratchpad: each step's log and observation in order, and the lead of the next thought."""
    return _joined(steps, by, order, F.concat(_text(log), F.lit("\n" + shown), _text(observation), F.lit("\n" + ask)), "", "scratchpad")


def tagged_scratchpad(steps: DataFrame, *, by: str = "run_id", order: str = "step", tool: str = "tool", given: str = "input", observation: str = "observation") -> DataFrame:
    """The same with tags: <tool>, <tool_input> and <observation>."""
    parts = (("tool", tool), ("tool_input", given), ("observation", observation))
    return _joined(steps, by, order, F.concat(*(x for tag, name in parts for x in (F.lit(f"<{tag}>"), _text(name), F.lit(f"</{tag}>")))), "", "scratchpad")


def step_messages(steps: DataFrame, *, by: str = "run_id", order: str = "step", log: str = "log", observation: str = "observation") -> DataFrame:
    """Two messages for each step: what the agent wrote, then what it saw. Columns by, turn from 0, role, text."""
    pair = F.array(F.struct(F.lit("assistant").alias("role"), _text(log).alias("text")), F.struct(F.lit("user").alias("role"), _text(observation).alias("text")))
    rows = steps.select(by, order, F.posexplode(pair).alias("half", "m"))
    return rows.select(by, (F.col(order) * 2 + F.col("half")).alias("turn"), "m.role", "m.text")


def trajectory(steps: DataFrame, *, by: str = "run_id", order: str = "step", tool: str = "tool", given: str = "input", observation: str = "observation") -> DataFrame:
    """by and trajectory: numbered steps with tool, input and output, for a judge to read."""
    number = (F.col(order) + 1).cast("string")
    line = F.concat(F.lit("Step "), number, F.lit(":\nTool used: "), _text(tool), F.lit("\nTool input: "), _text(given), F.lit("\nTool output: "), _text(observation))
    return _joined(steps, by, order, line, "\n\n", "trajectory")


def loop(tasks: DataFrame, model: Callable[[Column], Column], parse: Callable[[Column], Column], tools: Callable[[Column, Column], Column], *, most: int = 10, key: str = "run_id", question: str = "question") -> tuple[DataFrame, DataFrame]:
    """Agents for many tasks at once, a round for all that aren't done: (answers, steps).

    Each round prompts the model with the question and the scratchpad so far, parses its answer (struct of action, input,
    final, and error if it has one), and runs the tool. A task ends with a final answer, or without one after ``most`` rounds.
    answers: key, answer, rounds; steps: run_id, step, log, tool, input, observation. Each round's rows are stored.
    """
    kind = dict(tasks.dtypes)[key]
    live = stored(tasks.select(F.col(key).alias("run_id"), F.col(question).alias("question"), F.lit("").alias("pad")), "agents")
    spark = tasks.sparkSession
    answers = spark.createDataFrame([], f"run_id {kind}, answer string, rounds int")
    steps = spark.createDataFrame([], f"run_id {kind}, step int, log string, tool string, input string, observation string")
    for n in range(most):
        said = live.withColumn("log", model(F.concat("question", F.lit("\n"), "pad"))).withColumn("did", parse(F.col("log")))
        has_error = "error" in said.schema["did"].dataType.names
        problem = F.col("did.error") if has_error else F.lit(None).cast("string")
        said = stored(said.select("run_id", "question", "pad", "log", F.col("did.action").alias("tool"), F.col("did.input").alias("input"), F.col("did.final").alias("final"), problem.alias("problem")), "agents")
        answers = answers.unionByName(said.where("final IS NOT NULL").select("run_id", F.col("final").alias("answer"), F.lit(n + 1).alias("rounds")))
        seen = F.coalesce(F.col("problem"), tools(F.col("tool"), F.col("input")), F.lit("no such tool"))
        done = stored(said.where("final IS NULL").withColumn("observation", seen), "agents")
        steps = steps.unionByName(done.select("run_id", F.lit(n).alias("step"), "log", "tool", "input", "observation"))
        if not done.take(1):
            return answers, steps
        live = done.select("run_id", "question", F.concat("pad", "log", F.lit("\nObservation: "), "observation", F.lit("\nThought: ")).alias("pad"))
    return answers.unionByName(live.select("run_id", F.lit(None).cast("string").alias("answer"), F.lit(most).alias("rounds"))), steps


def allowed_tools(asked: DataFrame, chosen: Column, tools: list[str], most: int | None = None, always: tuple[str, ...] = ()) -> DataFrame:
    """asked with the tools a model has chosen (an array of names, best first): known ones, ``most`` at most, and some always."""
    known = F.array_distinct(F.filter(chosen, lambda t: t.isin(tools) & ~t.isin(*always) if always else t.isin(tools)))
    kept = known if most is None else F.slice(known, 1, most)
    return asked.withColumn("tools", F.concat(kept, F.array(*map(F.lit, always)).cast("array<string>")))


def decided(calls: DataFrame, decisions: DataFrame, *, key: str = "call_id", args: str = "args") -> DataFrame:
    """calls after people have looked at them (key, decision, args, message): approved ones as they are, edited ones with new
    arguments, rejected ones with a message and run = false. A call without a decision waits: it has no row."""
    d = decisions.select(key, "decision", F.col(args).alias("__args"), "message")
    known = F.col("decision").isin("approve", "edit", "reject")
    checked = F.when(known, F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("no such decision: "), F.coalesce("decision", F.lit("null")))))
    rows = calls.join(d, key).withColumn("decision", checked)
    rows = rows.withColumn(args, F.when(F.col("decision") == "edit", F.col("__args")).otherwise(F.col(args)))
    return rows.withColumn("run", F.col("decision") != "reject").withColumn("message", F.when(F.col("decision") == "reject", F.coalesce("message", F.lit("rejected")))).drop("__args")


TODO = ("pending", "in_progress", "completed")


def todos(state: DataFrame, changes: DataFrame, *, by: str = "run_id", item: str = "item", order: str = "step") -> DataFrame:
    """by, item, status: a to-do list after changes in order; the last status of an item counts, an unknown one is an error."""
    ok = F.when(F.col("status").isin(*TODO), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce("status", F.lit("null")))))
    new = changes.groupBy(by, item).agg(F.max_by("status", order).alias("status")).withColumn("status", ok)
    return state.join(new, [by, item], "left_anti").select(by, item, "status").unionByName(new)
