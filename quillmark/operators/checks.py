"""Learning checks: the gate, grading and what follows (section I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.running import running
from quillmark.operators import asof
from quillmark.operators.callbacks import preferences, turns_since


def gate(requests: DataFrame, sessions: DataFrame, users: DataFrame, concepts: DataFrame,
         quizzes: DataFrame, history: DataFrame) -> DataFrame:
    """May a check be offered at this turn? The first failing rule names the refusal.

    Requests are turns: turn_id, user_id, session_id, concept_id, created_at. The
    concept is judged by the evidence before the turn.
    """
    prefs = preferences(users).select("user_id", "check_gap")
    state = sessions.select("session_id", "activity")
    asked = requests.filter(F.col("concept_id").isNotNull()).select(
        "turn_id", "user_id", "concept_id", F.col("created_at").alias("at"))
    known = asof.scored_at(asked, history, concepts).select("turn_id", "score", "score_confidence")
    gaps = turns_since(requests, quizzes.select("user_id", F.col("created_at").alias("at")))
    joined = (
        requests.select("turn_id", "user_id", "session_id", "concept_id")
        .join(state, "session_id", "left").join(prefs, "user_id", "left")
        .join(known, "turn_id", "left")
        .join(gaps.select("turn_id", "turns_since"), "turn_id", "left"))
    sure = (F.col("score") >= V.CHECK_SKIP_SCORE) & (
        F.col("score_confidence") >= V.CONFIDENCE_FLOOR)
    return joined.select("turn_id", "user_id", (
        F.when(F.col("activity") == "QUIZ_PENDING", "quiz_already_pending")
        .when(F.col("check_gap").isNull(), "quiz_appetite_off")
        .when(sure, "quiz_not_needed")
        .when(F.col("turns_since") < F.col("check_gap"), "quiz_rate_limited")).alias("refused"))


def ground(requests: DataFrame, retrievals: DataFrame) -> DataFrame:
    """A check rests on its turn's passages, in rank order; none means refused."""
    sets = retrievals.groupBy("turn_id").agg(F.array_sort(F.collect_list(
        F.struct("rank_no", "chunk_id"))).alias("s")).select(
        "turn_id", F.transform("s", lambda x: x["chunk_id"]).alias("grounding_chunk_ids"))
    level = F.when(F.col("difficulty").isin(*V.DIFFICULTY), F.col("difficulty")).otherwise("medium")
    return requests.join(sets, "turn_id", "left").withColumns({
        "difficulty": level,
        "refused": F.when(F.col("grounding_chunk_ids").isNull(), "quiz_no_grounding")})


def grade_lexically(attempts: DataFrame) -> DataFrame:
    """A rubric point is covered when its words occur in the answer."""
    answer = F.lower(F.coalesce("answer_text", F.lit("")))
    rubric = F.coalesce("must_mention", F.array().cast("array<string>"))
    missing = F.filter(rubric, lambda p: ~F.contains(answer, F.lower(p)))
    return attempts.withColumn("missing_elements", missing).withColumn(
        "lexical_grade",
        F.when(F.size(rubric) == 0, "partial").when(F.size("missing_elements") == 0, "correct")
        .when(F.size("missing_elements") == F.size(rubric), "incorrect").otherwise("partial"))


def validate_grades(gradings: DataFrame) -> DataFrame:
    """A grade outside the closed set is never guessed: it becomes an error."""
    good = F.coalesce(F.col("returned_grade").isin(*V.GRADE), F.lit(False))
    answer = F.substring(F.trim(F.coalesce("answer_text", F.lit(""))), 1, 4000)
    return gradings.withColumns({
        "grade": F.when(good, F.col("returned_grade")),
        "grading_error": F.when(~good, F.coalesce(
            F.concat(F.lit("unknown grade "), F.col("returned_grade")), F.lit("grading failed"))),
        "answer_text": F.when(answer != "", answer).otherwise("(no answer)")})


def number_attempts(attempts: DataFrame) -> DataFrame:
    """One-based attempt numbers; a much-tried check is still spread over hours."""
    out = running(attempts, ["quiz_id"], ["created_at", "attempt_id"],
                  {"attempt_no": ("sum", F.lit(1))})
    return out.withColumn("attempt_no", F.col("attempt_no").cast("int"))


def next_actions(graded: DataFrame, quizzes: DataFrame, weak_prerequisites: DataFrame) -> DataFrame:
    """Where the reader goes next; a failed grading never keeps them waiting."""
    about = quizzes.select("quiz_id", "concept_id")
    blocking = weak_prerequisites.select("concept_id", "prerequisite_id")
    joined = graded.join(about, "quiz_id").join(blocking, "concept_id", "left")
    action = (
        F.when(F.col("grade").isNull() | (F.col("grade") == "correct"), "move_forward")
        .when((F.col("grade") == "incorrect") & F.col("prerequisite_id").isNotNull(),
              "revisit_prerequisite")
        .otherwise("explain_differently"))
    return joined.select(
        "attempt_id", "quiz_id", "grade", action.alias("next_action"),
        F.when(action == "revisit_prerequisite", F.col("prerequisite_id")).alias("prerequisite_id"),
        F.when(action == "move_forward", "FREE").otherwise("EXPLAINING").alias("activity"))


def check_signals(graded: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Evidence from graded attempts; failed gradings say nothing."""
    kind = X.lookup(F.col("grade"), V.SIGNAL_OF_GRADE)
    return graded.filter(F.col("grade").isNotNull()).join(
        quizzes.select("quiz_id", "concept_id"), "quiz_id").select(
        "attempt_id", "user_id", "concept_id", kind.alias("signal_type"),
        F.lit("quiz").alias("signal_source"), F.lit(V.WEIGHT_OF_SOURCE["quiz"]).alias("weight"))
