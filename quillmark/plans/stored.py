"""The fifteen stored tables as frames over the views, with every key, reference and checked column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import expr as X
from quillmark.plans.views import Views
from quillmark.schemas import TABLES
from quillmark.sources import catalog


def named(concepts: DataFrame) -> DataFrame:
    return concepts.withColumn("normalized_name", X.name_key(F.col("canonical_name")))


def tables(v: Views, **instead: DataFrame) -> dict[str, DataFrame]:
    """All tables; those given in place of one keep it from being derived."""
    made = {
        "users": lambda: v.full_users,
        "papers": lambda: v.papers,
        "user_paper_access": lambda: v.user_paper_access,
        "sections": lambda: v.sections,
        "chunks": lambda: v.chunks,
        "concepts": lambda: named(v.concepts),
        "concept_relationships": lambda: v.full_edges,
        "observations": lambda: v.full_observations,
        "sessions": lambda: v.full_sessions,
        "turns": lambda: v.turns,
        "messages": lambda: v.full_messages,
        "turn_retrievals": lambda: v.full_retrievals,
        "quizzes": lambda: v.full_quizzes,
        "quiz_attempts": lambda: v.full_attempts,
        "feedback": lambda: v.full_feedback,
    }
    return {t: instead[t] if t in instead else make() for t, make in made.items()}


def declared(v: Views) -> dict[str, DataFrame]:
    """The same rows in the form the catalog stores them: partition columns and nested values filled in."""
    out = tables(v)
    preferences = TABLES["users"].schema["preferences"].dataType
    rubric = F.struct("must_mention", "difficulty", F.lit("model").alias("authored_by"))
    out["users"] = out["users"].withColumn("preferences", F.from_json("preferences", preferences))
    out["quizzes"] = out["quizzes"].withColumns({"rubric": rubric, "question": F.lit("why?")})
    for name in ("sections", "chunks"):
        out[name] = catalog.with_bucket(out[name], 16)
    out["observations"] = out["observations"].withColumn("observed_date", F.to_date("observed_at"))
    for name in ("turns", "messages"):
        out[name] = out[name].withColumn("created_date", F.to_date("created_at"))
    return out
