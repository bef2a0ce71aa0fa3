"""Resolving mined concept names into one graph per reader (section G)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.shared import materialise, new_path
from quillmark.functions.similarity import blocked_top_k, order_key

CAND = ["user_id", "candidate_no"]


def new_id(user: Column, key: Column) -> Column:
    """A stable positive id for a reader's concept name."""
    digest = F.md5(F.concat_ws("|", user.cast("string"), key))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _keys(kind: int, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def name_keys(concepts: DataFrame) -> DataFrame:
    """(user_id, concept_id, kind, key) of unmerged concepts: the name key (0) and every raw alias (1)."""
    live = concepts.filter(F.col("merged_into_id").isNull())
    return live.select("user_id", "concept_id", _keys(0, F.col("normalized_name")).alias("k")).unionByName(
        live.select("user_id", "concept_id", F.explode(F.transform("aliases", lambda a: _keys(1, a))).alias("k"))).select(
        "user_id", "concept_id", "k.*")


def exact_match(candidates: DataFrame, concepts: DataFrame) -> DataFrame:
    """The existing concept a candidate names, by name key or by raw alias."""
    return match_keys(candidates, name_keys(concepts))


def match_keys(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """The owner of a key that a candidate names.

    Both sides are tagged key rows, so this is one equality join; the best
    owner of each key is chosen before the join, which keeps a very common
    alias to one row per reader.
    """
    owners = keys.groupBy("user_id", "kind", "key").agg(F.min("concept_id").alias("concept_id"))
    said = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    probes = F.concat(F.transform(said, lambda s: _keys(0, X.name_key(s))),
                      F.transform(said, lambda s: _keys(1, s)))
    asked = candidates.select(*CAND, F.explode(probes).alias("k")).select(
        *CAND, "k.*").distinct()
    hits = asked.join(owners, ["user_id", "kind", "key"])
    return hits.groupBy(*CAND).agg(
        F.min_by("concept_id", F.struct("kind", "concept_id")).alias("concept_id"))


def nearest_existing(candidates: DataFrame, concepts: DataFrame) -> DataFrame:
    """Closest stored concept of the same reader for each candidate."""
    near = blocked_top_k(
        candidates, concepts.filter(F.col("merged_into_id").isNull()), ["user_id"],
        "candidate_no", "concept_id", "vector", "embedding", 1)
    w = Window.partitionBy("candidate_no").orderBy(
        F.desc(order_key(F.col("similarity"))), "concept_id")
    return near.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def band(similarity: Column) -> Column:
    return F.when(F.round(similarity, 9) >= V.AMBIGUOUS_FROM, "ambiguous").otherwise("new")


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outcome per ambiguous pair; a missing verdict means distinct."""
    typed = F.when(F.col("relationship_type").isin(*V.RELATIONSHIP_TYPE),
                   F.col("relationship_type")).otherwise("co_occurs_with")
    merge = (F.col("verdict") == "same") & (F.col("verdict_confidence") >= V.MERGE_FROM)
    relate = (F.col("verdict") == "related") & (F.col("verdict_confidence") >= V.RELATE_FROM)
    known = verdicts.select("candidate_no", "verdict", "verdict_confidence", "relationship_type")
    return pairs.join(known, "candidate_no", "left").withColumns({
        "outcome": F.when(merge, "merge").when(relate, "edge").otherwise("distinct"),
        "edge_type": F.when(relate, typed)})


def verdict_gaps(pairs: DataFrame, verdicts: DataFrame, batch: list[str]) -> DataFrame:
    """Batches whose verdicts do not answer exactly the pairs that were asked."""
    asked = pairs.select(*batch, "candidate_no").withColumn("a", F.lit(1))
    got = verdicts.select(*batch, "candidate_no").withColumn("g", F.lit(1))
    return asked.join(got, [*batch, "candidate_no"], "full_outer").groupBy(*batch).agg(
        F.count("a").alias("pairs"), F.count("g").alias("verdicts"),
        F.count_if(F.col("g").isNull()).alias("unanswered"),
        F.count_if(F.col("a").isNull()).alias("unasked"))


def resolve_round(candidates: DataFrame, concepts: DataFrame, verdicts: DataFrame,
                  keys: DataFrame | None = None) -> DataFrame:
    """Recall for every candidate of the round before anything is committed.

    Each stage only sees what the one before left open. Adds ``matched_id``
    (existing concept, by name or by merge), ``nearest_id`` and the outcome.
    """
    keys = name_keys(concepts) if keys is None else keys
    exact = match_keys(candidates, keys).withColumnRenamed("concept_id", "exact_id")
    rest = candidates.join(exact, CAND, "left_anti")
    near = nearest_existing(rest, concepts).withColumn("band", band(F.col("similarity")))
    pairs = near.filter(F.col("band") == "ambiguous").select(
        "candidate_no", F.col("concept_id").alias("nearest_id"))
    judged = apply_verdicts(pairs, verdicts)
    joined = candidates.join(exact, CAND, "left").join(judged, "candidate_no", "left")
    merged = F.when(F.col("outcome") == "merge", F.col("nearest_id"))
    return joined.withColumn("matched_id", F.coalesce("exact_id", merged))


class Library(NamedTuple):
    """A reader's graph in long form: lists that grow are rows. ``at`` orders the rows of a concept."""

    concepts: DataFrame  # one row per concept, without its lists
    aliases: DataFrame  # user_id, concept_id, alias, at
    sources: DataFrame  # user_id, concept_id, paper_id, at
    edges: DataFrame


def _at(round_no: Column, candidate: Column, place: Column) -> Column:
    return F.struct(round_no.cast("int").alias("round"), candidate.cast("long").alias("candidate"),
                    place.cast("int").alias("place")).alias("at")


def unfold(concepts: DataFrame, edges: DataFrame) -> Library:
    def rows(column: str, item: str) -> DataFrame:
        zero = F.lit(0)
        return concepts.select("user_id", "concept_id", F.posexplode(column).alias("place", item)).select(
            "user_id", "concept_id", item, _at(zero, zero, F.col("place")))

    return Library(concepts.drop("aliases", "source_paper_ids"), rows("aliases", "alias"),
                   rows("source_paper_ids", "paper_id"), edges)


def fold(library: Library) -> DataFrame:
    """Concepts with their lists again, each item once, in the order it came. A list is a cell of the stored table."""
    def lists(rows: DataFrame, item: str, name: str) -> DataFrame:
        once = rows.groupBy("user_id", "concept_id", item).agg(F.min("at").alias("at"))
        gathered = F.array_sort(F.collect_list(F.struct("at", item)))
        return once.groupBy("user_id", "concept_id").agg(F.transform(gathered, lambda x: x[item]).alias(name))

    out = library.concepts
    for rows, item, name, empty in (
            (library.aliases, "alias", "aliases", "array<string>"),
            (library.sources, "paper_id", "source_paper_ids", "array<bigint>")):
        out = out.join(lists(rows, item, name), ["user_id", "concept_id"], "left").withColumn(
            name, F.coalesce(name, F.array().cast(empty)))
    return out


def additions(placed: DataFrame, round_no: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a round adds: new concepts (one per name key), alias rows and source rows.

    A new concept takes the aliases of its first candidate; a matched one those of all its candidates.
    """
    first = placed.filter("created").groupBy("user_id", "concept_id").agg(
        F.min_by(F.struct("name", "name_key", "vector"), F.col("candidate_no")).alias("r"),
        F.min("candidate_no").alias("first_no"))
    fresh = first.select(
        "user_id", "concept_id", F.substring("r.name", 1, 200).alias("canonical_name"),
        F.col("r.name_key").alias("normalized_name"), F.col("r.vector").alias("embedding"))
    says = placed.join(first.select("user_id", "concept_id", "first_no"), ["user_id", "concept_id"], "left").filter(
        ~F.col("created") | (F.col("candidate_no") == F.col("first_no")))
    named = says.select("user_id", "concept_id", "candidate_no", F.posexplode("aliases").alias("place", "alias"))
    aliases = named.select("user_id", "concept_id", "alias", _at(round_no, F.col("candidate_no"), F.col("place")))
    sources = placed.groupBy("user_id", "concept_id", "paper_id").agg(F.min("candidate_no").alias("no")).select(
        "user_id", "concept_id", "paper_id", _at(round_no, F.col("no"), F.lit(0)))
    return fresh, aliases, sources


def commit_concepts(concepts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Matched concepts gain papers and aliases; the rest are inserted once per name key.

    A name key that already exists (a concurrent twin) folds into its owner.
    """
    fresh, aliases, sources = additions(locate(concepts, resolved), F.lit(1))
    base = unfold(concepts, concepts.limit(0))
    return fold(Library(base.concepts.unionByName(fresh, allowMissingColumns=True),
                        base.aliases.unionByName(aliases), base.sources.unionByName(sources), base.edges))


def locate(concepts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Where each candidate ends up: an existing concept, or a new id for its name key."""
    key = F.substring(X.name_key(F.col("name")), 1, 200)
    keyed = resolved.withColumn("name_key", key)
    taken = concepts.filter(F.col("merged_into_id").isNull()).select(
        "user_id", F.col("normalized_name").alias("name_key"),
        F.col("concept_id").alias("twin_id"))
    out = keyed.join(taken, ["user_id", "name_key"], "left")
    known = F.coalesce("matched_id", "twin_id")
    return out.withColumn("created", known.isNull()).withColumn(
        "concept_id", F.coalesce(known, new_id(F.col("user_id"), F.col("name_key")))).drop("twin_id")


def related_edges(placed: DataFrame) -> DataFrame:
    """Typed edges from candidates judged related to an existing concept."""
    return placed.filter((F.col("outcome") == "edge") & F.col("exact_id").isNull()).select(
        "user_id", F.col("concept_id").alias("source_concept_id"),
        F.col("nearest_id").alias("target_concept_id"),
        F.col("edge_type").alias("relationship_type"),
        F.col("verdict_confidence").alias("confidence"), F.col("candidate_no").alias("seq"))


def prerequisite_edges(placed: DataFrame) -> DataFrame:
    """Edges from named prerequisites of the same paper that were resolved too."""
    ids = placed.select("user_id", "paper_id", F.col("name").alias("prerequisite"),
                        F.col("concept_id").alias("source_concept_id"))
    wants = placed.select(
        "user_id", "paper_id", F.col("concept_id").alias("target_concept_id"),
        F.col("candidate_no").alias("seq"), F.explode("prerequisites").alias("prerequisite"))
    return wants.join(ids, ["user_id", "paper_id", "prerequisite"]).select(
        "user_id", "source_concept_id", "target_concept_id",
        F.lit("prerequisite_of").alias("relationship_type"),
        F.lit(V.PREREQUISITE_CONFIDENCE).alias("confidence"), "seq")


EDGE_KEY = ["user_id", "source_concept_id", "target_concept_id", "relationship_type"]


def new_edges(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed edges that are no loops and not there yet; the first proposal wins."""
    firsts = proposed.filter(F.col("source_concept_id") != F.col("target_concept_id")).groupBy(
        *EDGE_KEY).agg(F.min_by("confidence", "seq").alias("confidence"))
    return firsts.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def run_result(placed: DataFrame, added: DataFrame) -> DataFrame:
    """Created, matched and edge counts per reader of the round."""
    once = Window.partitionBy("user_id", "concept_id").orderBy("candidate_no")
    counted = placed.withColumn("nth", F.row_number().over(once)).groupBy("user_id").agg(
        F.count_if(F.col("created") & (F.col("nth") == 1)).alias("created"),
        F.count_if(~F.col("created") | (F.col("nth") > 1)).alias("matched"))
    edges = added.groupBy("user_id").agg(F.count("*").alias("edges"))
    return counted.join(edges, "user_id", "left").fillna({"edges": 0})


def survivors(concepts: DataFrame) -> DataFrame:
    """The concept each row finally stands for after merges, however long the chain.

    Path doubling: every round doubles the chain length that is resolved, until
    all rows end at an unmerged concept. Rows that lead into a circle stand for
    its smallest id; they are what is left when a round resolves no row.
    """
    jump = concepts.select(
        "concept_id", F.coalesce("merged_into_id", "concept_id").alias("survivor_id"),
        F.least("concept_id", F.coalesce("merged_into_id", "concept_id")).alias("low"),
        F.col("merged_into_id").isNull().alias("done"))
    left = None
    while True:
        now = jump.filter("not done").count() if left is not None else -1
        if now == 0:
            return jump.select("concept_id", "survivor_id")
        if now == left:
            break
        left, jump = now, materialise(_doubled(jump), "jumps")
    circling = jump.filter("not done")
    for _ in range(max(1, left - 1).bit_length()):  # past every tail, and once around every circle
        circling = materialise(_doubled(circling), "circles")
    ends = circling.alias("a").join(circling.alias("b"), F.col("a.survivor_id") == F.col("b.concept_id"))
    return jump.filter("done").select("concept_id", "survivor_id").unionByName(
        ends.select("a.concept_id", F.col("b.low").alias("survivor_id")))


def _doubled(jump: DataFrame) -> DataFrame:
    """Every row jumps as far again as the row it points to; a missing row ends a chain."""
    nxt = jump.select(F.col("concept_id").alias("survivor_id"), F.col("survivor_id").alias("_next"),
                      F.col("low").alias("_low"), F.col("done").alias("_done"))
    return jump.join(nxt, "survivor_id", "left").select(
        "concept_id", F.coalesce("_next", "survivor_id").alias("survivor_id"),
        F.least("low", "_low").alias("low"), F.coalesce("_done", F.lit(True)).alias("done"))


class _Log:
    """An append-only table of a run, filed by round and by ``stage`` (the logarithm of a reader's rounds).

    A round that only readers with many papers still take part in reads only their stages.
    """

    def __init__(self, root: str, name: str):
        self.path, self.schema = f"{root}/{name}", None

    def add(self, rows: DataFrame, round_no: int) -> None:
        self.schema = self.schema or rows.schema
        rows.select(*self.schema.names).write.mode("overwrite").partitionBy("stage").parquet(f"{self.path}/round={round_no}")

    def before(self, spark, round_no: int | None = None) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        found = spark.read.schema(f"{kinds}, round int").option("basePath", self.path).parquet(self.path)
        if round_no is None:
            return found
        return found.filter((F.col("round") < round_no) & (F.col("stage") >= round_no.bit_length() - 1))


def grow(candidates: DataFrame, library: Library, judge: Callable[[DataFrame], DataFrame]) -> Library:
    """Run papers in arrival order: round r takes every reader's r-th paper at once.

    Candidates need ``arrival``. Order matters between a reader's papers, so rounds follow one another; all readers
    share a round. Nothing that is there is written again: a round reads the readers that still have papers, and
    appends what it adds, so a lost executor costs one round at most. ``judge`` maps ambiguous pairs to verdicts.
    """
    spark = candidates.sparkSession
    root = new_path(spark, "canonical")
    w = Window.partitionBy("user_id").orderBy("arrival", "paper_id")
    arrivals = candidates.select("user_id", "paper_id", "arrival").distinct().withColumn(
        "round_no", F.row_number().over(w))
    readers = materialise(arrivals.groupBy("user_id").agg(
        F.floor(F.log2(F.max("round_no"))).cast("int").alias("stage")), "readers")
    staged = materialise(
        candidates.join(arrivals, ["user_id", "paper_id", "arrival"]).join(readers, "user_id")
        .repartitionByRange("round_no", "user_id"), "rounds")
    last = staged.agg(F.max("round_no")).first()[0] or 0
    active = lambda rows: rows.join(readers, "user_id")
    live = library.concepts.filter(F.col("merged_into_id").isNull())
    names, aliases, sources, edges = (_Log(root, n) for n in ("names", "aliases", "sources", "edges"))
    names.add(active(live.select("user_id", "concept_id", "canonical_name", "normalized_name", "embedding")), 0)
    aliases.add(active(library.aliases.join(live.select("user_id", "concept_id"), ["user_id", "concept_id"], "left_semi")), 0)
    sources.add(active(library.sources).limit(0), 0)
    edges.add(active(library.edges.select(*EDGE_KEY, "confidence")), 0)
    for r in range(1, last + 1):
        now = staged.filter(F.col("round_no") == r)
        known = names.before(spark, r).withColumn("merged_into_id", F.lit(None).cast("long"))
        said = aliases.before(spark, r).select("user_id", "concept_id", F.lit(1).alias("kind"), F.col("alias").alias("key"))
        keys = known.select("user_id", "concept_id", F.lit(0).alias("kind"), F.col("normalized_name").alias("key")).unionByName(said)
        resolved = materialise(resolve_round(now, known, judge(now), keys), "resolved")
        more = materialise(locate(known, resolved), "placed")
        fresh, alias_rows, source_rows = additions(more, F.lit(r))
        proposed = related_edges(more).unionByName(prerequisite_edges(more))
        added = new_edges(edges.before(spark, r), proposed)
        for log, rows in ((names, fresh), (aliases, alias_rows), (sources, source_rows), (edges, added)):
            log.add(active(rows), r)

    def gained(log: _Log) -> DataFrame:
        return log.before(spark).filter("round > 0").drop("round", "stage")

    return Library(
        library.concepts.unionByName(gained(names), allowMissingColumns=True), library.aliases.unionByName(gained(aliases)),
        library.sources.unionByName(gained(sources)), library.edges.select(*EDGE_KEY, "confidence").unionByName(gained(edges)))


def canonicalize(
    candidates: DataFrame, concepts: DataFrame, edges: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """``grow`` from and to stored tables: the lists are put together once, at the end."""
    grown = grow(candidates, unfold(concepts, edges), judge)
    return fold(grown), grown.edges


def rebuild(user_ids: DataFrame, candidates: DataFrame, concepts: DataFrame, edges: DataFrame,
            judge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Derive some readers' concepts again from stored candidates."""
    who = user_ids.select("user_id").distinct()
    kept = concepts.join(who, "user_id", "left_anti")
    kept_edges = edges.join(who, "user_id", "left_anti")
    return canonicalize(candidates.join(who, "user_id", "left_semi"), kept, kept_edges, judge)
