"""A question's way through the stages as a state table: verdicts drive retries until they accept, abstain or the budget is used.

The frontier holds one row for each open question: its attempt, thresholds, evidence, answer and verdict. A round

1. decides each open row by its last verdict: it ends, or one of three retries is taken;
2. makes the retry's evidence: locating again with a lower threshold, widening the context around the packets that the verdict names, or
   nothing new for a retry of the answer alone;
3. takes the recorded answer and verdict of the next attempt, which the open rows carry.

What was recorded meets its question once, before the first round, so a round shuffles nothing. Each round's rows are written before the
next (`keep`), so a lost executor repeats one round and plans stay short; of ended rows only what the result needs is written. There are
as many rounds as the largest retry budget allows, not as many as rows; ended rows are not touched again.

Tables
- questions: example_id, question, answer_type, regions (array of struct id, confidence), neighbours (array of struct of, id, distance).
- answers: example_id, attempt, answer, citations, confidence; answers of attempt 0 may have a second row with `nudged` true: what was said
  when an abstention that cites evidence was asked again.
- verdicts: example_id, attempt, supported, next_action, targets, shape_failure.

Defined results: an attempt without a recorded answer or verdict ends its question as `unrecorded`, with the answer before it; null flags are
false, null arrays empty; an unknown action is accepted as it stands; several recorded rows of one attempt are an error of the
recording, of which the least row is taken; questions without regions go on with no evidence; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contracts, policies
from ..operators.evidence import strongest_attempt
from ..sources.staging import stage

RETRIES = ("retry_localization", "expand_context", "escalate_reasoner")
ATTEMPT = "struct<answer:string,citations:array<string>,confidence:double>"
#: Stages that each retry runs again before its answer.
AGAIN = {"retry_localization": ("localize", "rerank", "inspect", "expand_context"), "expand_context": ("expand_context",), "escalate_reasoner": ()}
BEFORE = ("plan", "route_pages", "localize", "rerank", "inspect", "expand_context")


class State:
    """The columns of a state row by name."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def _keeps_initial(s: State) -> Column:
    contract = contracts.answer_contract(s["question"], s["answer_type"])
    return policies.keeps_initial_answer(s["initial"], s["current"], s["question"], contract, s["attempt"])


def _keeps_estimate(s: State) -> Column:
    """A cited, sure, scalar answer to a question that asks for a visual estimate outlives a first verdict that abstains."""
    now = s["current"]
    return (s["attempt"] == 0) & (F.size(now["citations"]) > 0) & (now["confidence"] >= 0.7) & policies.asks_estimate(s["question"]) & policies.is_scalar(now["answer"])


@dataclass(frozen=True)
class Policy:
    """Budgets and steps of the retries. The defaults are those that results are compared under."""

    max_retries: int = 0
    max_evidence_retries: int = 1
    threshold: float = 0.3
    threshold_step: float = 0.7
    pad: float = 0.08
    pad_step: float = 1.5
    most_pad: float = 0.30
    late_abstention: float = 0.45
    nudge: bool = True
    keeps_initial: Callable[[State], Column] = field(default=_keeps_initial)
    keeps_estimate: Callable[[State], Column] = field(default=_keeps_estimate)

    @property
    def rounds(self) -> int:
        return max(self.max_retries, self.max_evidence_retries)


def strings(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def unanswerable_type(answer_type: Column) -> Column:
    return F.coalesce(F.lower(answer_type).endswith("unanswerable"), F.lit(False))


def located(s: State, threshold: Column) -> Column:
    return F.transform(F.filter(s["regions"], lambda r: r["confidence"] >= threshold), lambda r: r["id"])


def widened(s: State, evidence: Column, targets: Column, pad: Column) -> Column:
    """Evidence with the neighbours, within pad, of the targets that it holds."""
    near = F.filter(s["neighbours"], lambda n: F.array_contains(targets, n["of"]) & F.array_contains(evidence, n["of"]) & (n["distance"] <= pad))
    return F.array_union(evidence, F.transform(near, lambda n: n["id"]))


#: What a row is asked for after it has ended.
KEPT = ("example_id", "attempt", "ended", "current", "initial", "scope", "stages", "supported", "initial_supported", "evidence_retries", "tool_retry")


def _recorded(answers: DataFrame, verdicts: DataFrame, p: Policy) -> tuple[DataFrame, DataFrame]:
    """example_id and one struct of what was recorded for each attempt that the budget reaches: _a0 and so on with _b of the second question, _v0 and so on."""
    of = lambda chosen, *columns: F.min(F.when(chosen, F.struct(*columns)))
    at = lambda i: F.col("attempt") == i
    again = F.coalesce("nudged", F.lit(False)) if "nudged" in answers.columns else F.lit(False)
    said = ("answer", "citations", "confidence")
    a = answers.groupBy("example_id").agg(*[of(at(i) & ~again, *said).alias(f"_a{i}") for i in range(p.rounds + 1)], of(at(0) & again, *said).alias("_b"))
    v = verdicts.groupBy("example_id").agg(*[of(at(i), "supported", "next_action", "targets", "shape_failure").alias(f"_v{i}") for i in range(p.rounds + 1)])
    return a, v


def _answered(open_: DataFrame, attempt: int, nudge: bool) -> DataFrame:
    """Open rows with the answer and verdict of an attempt; citations are of evidence that the answer was given."""
    out = open_.withColumnsRenamed({f"_a{attempt}": "_a", f"_v{attempt}": "_v"})
    clean = lambda a: F.struct(a["answer"].alias("answer"), F.array_intersect(F.coalesce(a["citations"], strings()), F.col("scope")).alias("citations"), F.coalesce(a["confidence"], F.lit(0.0)).alias("confidence"))
    given = F.when(F.col("_a").isNotNull(), clean(F.col("_a")))
    out = out.withColumn("_given", given).withColumn("stages", F.concat("stages", F.when(F.col("_a").isNotNull(), strings("answer")).otherwise(strings())))
    if nudge and attempt == 0:
        gone = policies.looks_unanswerable
        asked = F.col("_given").isNotNull() & gone(F.col("_given.answer")) & (F.size("_given.citations") > 0) & (F.size("scope") > 0)
        out = out.withColumn("_asked", F.coalesce(asked & F.col("_b").isNotNull(), F.lit(False)))
        out = out.withColumn("stages", F.concat("stages", F.when(F.col("_asked"), strings("answer")).otherwise(strings())))
        out = out.withColumn("_given", F.when(F.col("_asked") & ~gone(F.col("_b.answer")), clean(F.col("_b"))).otherwise(F.col("_given"))).drop("_asked")
    both = F.col("_given").isNotNull() & F.col("_v").isNotNull()
    said = lambda c, default: F.coalesce(F.col(f"_v.{c}"), default)
    out = out.withColumns({
        "_ok": both, "attempt": F.lit(attempt), "ended": F.when(~both, "unrecorded"), "current": F.coalesce("_given", "current"),
        "stages": F.concat("stages", F.when(both, strings("verify")).otherwise(strings())),
        "supported": F.when(both, said("supported", F.lit(False))).otherwise(F.coalesce("supported", F.lit(False))), "next_action": F.col("_v.next_action"),
        "targets": said("targets", strings()), "shape_failure": said("shape_failure", F.lit(False)),
    }).drop("_a", "_b", "_v", "_given")
    weak = F.array(F.struct(F.col("current.answer").alias("answer"), F.size("current.citations").alias("n_citations"), F.col("current.confidence").alias("confidence"), F.lit(attempt).alias("attempt"), F.col("current.citations").alias("citations"), F.col("scope").alias("scope")))
    return out.withColumn("unsupported", F.when(F.col("_ok") & ~F.col("supported"), F.concat("unsupported", weak)).otherwise(F.col("unsupported"))).drop("_ok")


def decided(df: DataFrame, p: Policy, keeps_initial: Column, keeps_estimate: Column) -> DataFrame:
    """Rows with `ended` set where the last verdict or the budget ends them, and the answer that they end with. The rules are columns over a state row."""
    df = df.withColumn("_best", F.when(F.size("unsupported") > 0, strongest_attempt(F.col("unsupported"))))
    s = State()
    action = F.coalesce(s["next_action"], F.lit(""))
    budget = F.when(action == "expand_context", p.rounds).otherwise(p.max_retries)
    reshape = (action == "escalate_reasoner") & ~s["supported"] & (F.size(s["current"]["citations"]) > 0) & s["shape_failure"]
    budget = F.when(reshape, p.rounds).otherwise(budget)
    best = s["_best"]
    typed = ~unanswerable_type(s["answer_type"])
    keeps_now = ~s["supported"] & typed & ~policies.looks_unanswerable(s["current"]["answer"]) & keeps_estimate
    keeps_best = (s["attempt"] > 0) & typed & (F.size(best["citations"]) > 0) & ~policies.looks_unanswerable(best["answer"]) & (best["confidence"] >= p.late_abstention)
    ends = (
        F.when(s["ended"].isNotNull(), s["ended"])
        .when(action == "accept", F.when(F.coalesce(keeps_initial, F.lit(False)), "accepted_preserved_initial").otherwise("accepted"))
        .when(action == "abstain", F.when(F.coalesce(keeps_now, F.lit(False)) | F.coalesce(keeps_best, F.lit(False)), "exhausted").otherwise("abstained"))
        .when(action.isin(*RETRIES), F.when(s["attempt"] >= budget, "exhausted"))
        .otherwise("accepted")
    )
    kept = F.struct(best["answer"].alias("answer"), best["citations"].alias("citations"), best["confidence"].alias("confidence"))
    silent = F.struct(F.lit("Unanswerable").alias("answer"), strings().alias("citations"), s["current"]["confidence"].alias("confidence"))
    # an abstention that keeps the present estimate still ends as exhausted, where the strongest unsupported answer stands
    weaker = (ends == "exhausted") & ~s["supported"] & best.isNotNull()
    answer = F.when(ends == "accepted_preserved_initial", s["initial"]).when(ends == "abstained", silent).when(weaker, kept).otherwise(s["current"])
    scope = F.when(ends == "accepted_preserved_initial", s["initial_scope"]).when(weaker, best["scope"]).otherwise(s["scope"])
    return df.withColumn("_ends", ends).withColumns({"ended": F.col("_ends"), "current": F.when(F.col("_ends").isNotNull(), answer).otherwise(F.col("current")), "scope": F.when(F.col("_ends").isNotNull(), scope).otherwise(F.col("scope"))}).drop("_best", "_ends")


def prepared(df: DataFrame, p: Policy) -> DataFrame:
    """Open rows with the evidence of the retry that their verdict asks for."""
    s = State()
    again, wider = s["next_action"] == "retry_localization", s["next_action"] == "expand_context"
    threshold = F.when(again, s["threshold"] * p.threshold_step).otherwise(s["threshold"])
    pad = F.when(wider, F.least(s["pad"] * p.pad_step, F.lit(p.most_pad))).otherwise(s["pad"])
    df = df.withColumns({"threshold": threshold, "pad": pad, "_again": again, "_wider": wider})
    named = F.array_intersect(s["targets"], s["evidence"])
    targets = F.when(F.size(named) > 0, named).otherwise(s["current"]["citations"])
    first = located(s, s["threshold"])
    evidence = F.when(s["_again"], widened(s, first, first, s["pad"])).when(s["_wider"], widened(s, s["evidence"], targets, s["pad"])).otherwise(s["evidence"])
    df = df.withColumns({"_targets": targets, "evidence": evidence})
    about = F.array_union(s["_targets"], F.array_union(s["current"]["citations"], widened(s, s["_targets"], s["_targets"], s["pad"])))
    focused = F.array_intersect(s["evidence"], about)
    scope = F.when(s["_wider"] & (F.size(focused) > 0), focused).otherwise(s["evidence"])
    run = F.coalesce(*[F.when(s["next_action"] == a, strings(*AGAIN[a])) for a in RETRIES], strings())
    return df.withColumns({"scope": scope, "stages": F.concat("stages", run), "evidence_retries": s["evidence_retries"] + s["_wider"].cast("int"), "tool_retry": s["tool_retry"] | s["_again"] | s["_wider"]}).drop("_again", "_wider", "_targets")


def run(questions: DataFrame, answers: DataFrame, verdicts: DataFrame, policy: Policy = Policy(), keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """example_id, answer, citations, confidence, ended, retries, evidence_retries, supported, helped, changed, stages, evidence: one row a question.

    helped: whether retries turned an unsupported answer into a supported one (null without retries). changed: whether the answer
    differs from the first one after a retry that looked for evidence.
    """
    p = policy
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    start = questions.select("example_id", "question", "answer_type", empty("regions", "array<struct<id:string,confidence:double>>").alias("regions"), empty("neighbours", "array<struct<of:string,id:string,distance:double>>").alias("neighbours"))
    s = State()
    first = located(s, F.lit(p.threshold))
    start = start.withColumns({
        "threshold": F.lit(p.threshold), "pad": F.lit(p.pad), "evidence": widened(s, first, first, F.lit(p.pad)), "stages": strings(*BEFORE), "current": F.lit(None).cast(ATTEMPT),
        "supported": F.lit(False), "evidence_retries": F.lit(0), "tool_retry": F.lit(False),
        "unsupported": F.array().cast("array<struct<answer:string,n_citations:int,confidence:double,attempt:int,citations:array<string>,scope:array<string>>>"),
    }).withColumn("scope", F.col("evidence"))
    for recorded in _recorded(answers, verdicts, p):
        start = start.join(recorded, "example_id", "left")
    now = _answered(start, 0, p.nudge).withColumns({"initial": F.col("current"), "initial_scope": F.col("scope"), "initial_supported": F.col("supported")})
    done: list[DataFrame] = []
    no = F.lit(False)
    estimate, initial = p.keeps_estimate(State()), p.keeps_initial(State()) if p.rounds else no  # large expressions: put together once
    for attempt in range(p.rounds + 1):
        now = decided(now, p, initial if attempt else no, no if attempt else estimate)
        now = keep(now.withColumns({c: F.when(F.col("ended").isNull(), F.col(c)) for c in now.columns if c not in KEPT}))
        done.append(now.where("ended is not null").select(*KEPT))
        if attempt == p.rounds:
            break
        open_ = now.where("ended is null")
        if open_.isEmpty():
            break
        now = _answered(prepared(open_, p), attempt + 1, p.nudge)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    retries = F.col("attempt")
    kept = F.col("ended") == "accepted_preserved_initial"
    return out.select(
        "example_id", F.col("current.answer").alias("answer"), F.coalesce("current.citations", strings()).alias("citations"), F.col("current.confidence").alias("confidence"), "ended", retries.alias("retries"), "evidence_retries", "supported",
        F.when(retries > 0, ~F.col("initial_supported") & F.col("supported") & ~kept).alias("helped"),
        (F.col("tool_retry") & ~policies.normal_answer(F.col("current.answer")).eqNullSafe(policies.normal_answer(F.col("initial.answer")))).alias("changed"), "stages", F.col("scope").alias("evidence"),
    )
