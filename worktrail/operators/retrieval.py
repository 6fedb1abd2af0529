"""Top-k events per question, exact, without scoring every pair.

The lexical score of an event for a question depends only on which of the project's
question words the event holds: its signature. Events that share a signature and all
few-valued bonuses differ by one growing bonus and time, so the best k of each such class
are enough, and classes instead of events meet the questions, once per set of question
words. Words that all classes of a project hold (its name, its kinds of events) add the
same to every one of them and stay out of that join. The best k events of the project by
bonus and time join in, for questions that meet nothing else.

Postings (project, word, class) are read by impact. The head block of each list, its classes
with most question words, and the newest events give every question a k-th score; what can't
reach that score is left unread: a class needs so many of the question's words that it holds
one of the rarest, so the longest lists are skipped, and so that a list is read down to the
classes with that many question words only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worktrail.functions.profile_text import event_text, search_text
from worktrail.functions.text import str_array, tokens
from worktrail.operators.ordering import group_positions, joined_list, top_rows
from worktrail.session import pinned

# Question words about time, and words that mark a workflow step.
TEMPORAL_WORDS = ["latest", "current", "now", "still", "before", "after", "exception", "update", "default", "habit"]
SIGNAL_WORDS = [
    "assign", "assigned", "blocked", "boundary", "ci", "close", "failed", "label", "merge", "pipeline", "review", "triage", "validation",
]


#: Classes in the head block of a posting list.
HEAD = 32
#: Question words of a project up to which they travel as one array.
VOCABULARY = 512


def question_words(probes: DataFrame) -> DataFrame:
    words = F.array_distinct(tokens(F.col("query")))
    temporal = F.when(F.arrays_overlap("words", str_array(TEMPORAL_WORDS)), F.lit(0.1)).otherwise(F.lit(0.0))
    return probes.select("project_id", "probe_id", words.alias("words")).withColumn("probe_bonus", temporal)


def _total(base: Column, bonuses: list[str]) -> Column:
    """Bonuses added one after another, in this order."""
    return reduce(lambda acc, b: acc + F.col(b), bonuses, base)


def _signatures(base: DataFrame, vocabulary: DataFrame, keyed: list[str]) -> DataFrame:
    """The question words that each event holds. A project's question words travel as one array,
    so that an event stays one row; only those of a project that asks for more than VOCABULARY
    words meet its events word by word."""
    text = lambda words: F.array_join(F.array_sort(words), " ").alias("signature")
    sizes = vocabulary.groupBy("project_id").agg(F.count("*").alias("n"))
    some = vocabulary.join(sizes.filter(F.col("n") <= VOCABULARY), "project_id", "left_semi").groupBy("project_id").agg(F.collect_set("word").alias("asked_words"))
    held = F.array_intersect("words", "asked_words")
    by_event = base.join(some, "project_id").withColumn("met", held).filter(F.size("met") > 0).select(*keyed, text(F.col("met")))
    many = vocabulary.join(sizes.filter(F.col("n") > VOCABULARY), "project_id", "left_semi")
    by_word = (
        base.join(many.select("project_id").distinct(), "project_id", "left_semi")
        .select(*keyed, F.explode_outer("words").alias("word"))
        .join(many, ["project_id", "word"])
        .groupBy(*keyed)
        .agg(text(F.collect_set("word")))
    )
    return by_event.unionByName(by_word)


def _first_distinct(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows that may be among the first n different ones of a group, each once. Copies of
    a row share its rank, so that map tasks still cut their groups before the shuffle."""
    rest = [F.asc(c) for c in rows.columns if c not in keys]
    place = F.dense_rank().over(W.partitionBy(*keys).orderBy(*order, *rest))
    return rows.withColumn("rn", place).filter(F.col("rn") <= n).drop("rn").dropDuplicates()


def retrieve(
    events: DataFrame, probes: DataFrame, k: int = 5, bonuses: tuple[str, ...] = (), probe_bonus: bool = False,
    signal_weight: float = 0.0, recency_key: str = "ts", classes: tuple[str, ...] = (), trace: dict | None = None,
) -> DataFrame:
    """Best k events per probe as (project_id, probe_id, event_id, score, rank).

    ``events`` holds project_id, event_id, ord, words, the recency key and the bonus
    columns; ``probes`` is question_words(). Events that score above zero win; only where
    none does, the newest fill in. Ties go to the newer event, then to file order. All
    bonuses but one have to be ``classes``: columns with a few values each. ``trace`` receives
    the posting lists and what each set of question words reads of them.
    """
    bonuses = list(bonuses)
    few = list(classes)
    own = _total(F.lit(0.0), bonuses)
    # Inside a class the lexical score and the few-valued bonuses are the same, so that the
    # order of the remaining bonus is the order of the sums, rounding included.
    newest = [*[F.desc(b) for b in bonuses if b not in few], F.desc(recency_key), F.asc("ord")]
    base = events.select("project_id", "event_id", "ord", recency_key, "words", *bonuses).withColumn("own", own)
    questions = probes.withColumn("n_words", F.size("words")).withColumn("asked", F.array_join(F.array_sort("words"), " "))
    sets = questions.groupBy("project_id", "asked").agg(F.first("words").alias("words"), F.first("n_words").alias("n_words"), F.first("probe_bonus").alias("probe_bonus"))
    posting = sets.select("project_id", "asked", F.explode("words").alias("word"))
    vocabulary = posting.select("project_id", "word").distinct()

    def score(hits: Column, signals: Column) -> Column:
        lexical = F.when(F.col("n_words") > 0, hits / F.col("n_words")).otherwise(F.lit(0.0))
        if signal_weight:
            lexical = lexical + F.lit(signal_weight) * signals
        total = _total(lexical, bonuses)
        return total + F.col("probe_bonus") if probe_bonus else total

    keyed = ["project_id", "event_id", "ord", recency_key, *bonuses, "own"]
    signatures = _signatures(base, vocabulary, keyed)
    group = ["project_id", "signature", *few]
    order = [F.desc("score"), F.desc(recency_key), F.asc("ord")]
    # Written, as three steps read it: the events' words are met with the questions' once.
    best = pinned(top_rows(_first_distinct(signatures, group, newest, k), group, newest, k, "place"))
    heads = best.filter("place = 1").select(*dict.fromkeys([*group, "ord", recency_key, *bonuses])).withColumn("held", F.split("signature", " "))
    lists = heads.withColumn("impact", F.size("held")).withColumn("word", F.explode("held"))
    classes_of = heads.groupBy("project_id").agg(F.count("*").alias("heads"))
    lengths = pinned(lists.groupBy("project_id", "word").agg(F.count("*").alias("length")).join(classes_of, "project_id"))
    # Of a question's words: those of all classes, and the others from the rarest on.
    known = posting.join(lengths, ["project_id", "word"])
    fixed = known.filter("length = heads").groupBy("project_id", "asked").agg(F.collect_set("word").alias("everywhere"))
    partly = known.filter("length < heads").groupBy("project_id", "asked").agg(F.array_sort(F.collect_list(F.struct("length", "word"))).alias("by_length"))
    none = F.array().cast("array<string>")
    asked = pinned(
        sets.join(fixed, ["project_id", "asked"], "left")
        .join(partly, ["project_id", "asked"], "left")
        .withColumn("everywhere", F.coalesce("everywhere", none))
        .withColumn("rare", F.coalesce(F.col("by_length.word"), none))
        .drop("by_length")
    )
    signals_in = lambda c: F.size(F.array_intersect(c, str_array(SIGNAL_WORDS)))

    def met_by(read: DataFrame, postings: DataFrame, when: Column) -> DataFrame:
        """Classes that questions meet in the lists they read (read: project_id, asked, word, rare,
        everywhere, ...), with exact scores; each class once, through its rarest common word."""
        rows = read.join(postings, ["project_id", "word"]).filter(when)
        shared = F.array_intersect("rare", "held")
        rows = rows.withColumn("shared", shared).filter(F.col("shared")[0] == F.col("word"))
        rows = rows.withColumn("hits", F.size("shared") + F.size("everywhere")).withColumn("signals", signals_in(F.concat("shared", "everywhere")))
        return rows.withColumn("score", score(F.col("hits"), F.col("signals")))

    columns = ["project_id", "asked", "event_id", "ord", recency_key, "score"]
    latest = top_rows(base, ["project_id", *few], newest, k, "place").drop("place").withColumnRenamed("words", "event_words")
    shared = F.array_intersect("words", "event_words")
    filling = pinned(
        sets.join(latest, "project_id")
        .withColumn("score", score(F.size(shared), signals_in(shared)))
        .select(*columns)
    )
    # The k-th score that some events certainly have.
    each = asked.select("project_id", "asked", "n_words", "probe_bonus", "everywhere", "rare", F.posexplode("rare").alias("at", "word"))
    block = top_rows(lists, ["project_id", "word"], [F.desc("impact"), *newest], HEAD, "place").drop("place")
    first = met_by(each, block, F.lit(True)).select("project_id", "asked", "ord", recency_key, "score", "signature")
    sure = top_rows(filling.select("project_id", "asked", "ord", recency_key, "score", F.lit("").alias("signature")).unionByName(first), ["project_id", "asked"], order, 2 * k, "place")
    # An event may stand in both: the k-th of its distinct places in time and file.
    scores = sure.groupBy("project_id", "asked", recency_key, "ord").agg(F.max("score").alias("score"))
    kth = scores.groupBy("project_id", "asked").agg(F.array_sort(F.collect_list(-F.col("score"))).alias("scores"))
    kth = kth.select("project_id", "asked", (-F.get("scores", F.lit(k - 1))).alias("kth"))
    most = base.groupBy("project_id").agg(F.max("own").alias("most"))
    # So many of its other words a class has to hold; rounding is allowed for.
    per_word = F.lit(1.0) / F.greatest(F.lit(1), F.col("n_words")) + F.lit(signal_weight)
    gap = F.col("kth") - F.col("most") - (F.col("probe_bonus") if probe_bonus else F.lit(0.0)) - F.lit(1e-9)
    least = F.greatest(F.lit(1), F.ceil(gap / per_word).cast("int") - F.size("everywhere"))
    needed = asked.join(kth, ["project_id", "asked"], "left").join(most, "project_id").withColumn("least", F.coalesce(least, F.lit(1)))
    read = needed.withColumn("listed", F.size("rare") - F.col("least") + 1).filter("listed > 0")
    read = read.select("project_id", "asked", "n_words", "probe_bonus", "everywhere", "rare", "least", F.explode(F.slice("rare", F.lit(1), F.col("listed"))).alias("word"))
    if trace is not None:
        trace |= {"lists": lists, "asked": asked, "read": read}
    met = met_by(read, lists, F.col("impact") >= F.col("least") + F.size("everywhere"))
    leading = top_rows(met, ["project_id", "asked"], order, k, "place").select("asked", *group, "n_words", "probe_bonus", "hits", "signals")
    matched = best.drop("place").join(leading, group).withColumn("score", score(F.col("hits"), F.col("signals"))).select(*columns)

    # At most k * k + k candidates for each class of bonuses and set of words from here on.
    pool = matched.unionByName(filling).dropDuplicates(["project_id", "asked", "event_id"])
    top = F.max("score").over(W.partitionBy("project_id", "asked"))
    kept = pool.withColumn("top", top).filter("score > 0 or top <= 0").drop("top")
    ranked = top_rows(kept, ["project_id", "asked"], order, k, "rank")
    return questions.select("project_id", "probe_id", "asked").join(ranked, ["project_id", "asked"]).select(
        "project_id", "probe_id", "event_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


def with_search_words(events: DataFrame) -> DataFrame:
    text = search_text(F.col("content"), F.col("claims"), F.col("project_tags"), F.col("entities"))
    return events.withColumn("words", F.array_distinct(tokens(text)))


def with_public_words(events: DataFrame) -> DataFrame:
    text = event_text(F.col("event_type"), F.col("actor"), F.col("content"), F.col("claims"), F.col("entities"))
    return events.withColumn("words", F.array_distinct(tokens(text)))


def recency(events: DataFrame) -> DataFrame:
    """Place of each event in its project's time order, from 0 to 1."""
    placed = group_positions(events.select("project_id", "ts", "ord", "event_id"), ["project_id"], ["ts", "ord"])
    return placed.withColumn("recency", F.col("pos") / F.greatest(F.lit(1), F.col("group_rows") - 1))


def later_penalty(events: DataFrame, cap: int = 10) -> DataFrame:
    """0.05 per strictly later event of the project, ten at most. The newest ten rows of a
    project decide it, so no event is compared with all others."""
    newest = top_rows(events.select("project_id", "timestamp", "ord"), ["project_id"], [F.desc("timestamp"), F.asc("ord")], cap)
    tails = newest.groupBy("project_id").agg(F.collect_list("timestamp").alias("newest"))
    later = F.size(F.filter("newest", lambda t: t > F.col("timestamp")))
    return events.join(tails, "project_id").withColumn("later", later.cast("bigint")).withColumn(
        "penalty", F.lit(0.05) * F.col("later")
    ).drop("newest")


def topk_lexical(events: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    return retrieve(with_search_words(events), question_words(probes), k)


def topk_temporal(events: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    placed = recency(events).select("project_id", "event_id", "recency")
    text = F.lower(search_text(F.col("content"), F.col("claims"), F.col("project_tags"), F.col("entities")))
    updated = (F.size("supersedes") > 0) | (F.size("invalidates") > 0) | F.col("validity").isNotNull()
    policy = F.col("event_type").contains("policy_update") | text.contains("exception")
    ready = (
        with_search_words(events)
        .join(placed, ["project_id", "event_id"])
        .withColumn("recency_bonus", F.lit(0.15) * F.col("recency"))
        .withColumn(
            "update_bonus", F.when(updated, F.lit(0.2)).otherwise(F.lit(0.0)) + F.when(policy, F.lit(0.15)).otherwise(F.lit(0.0))
        )
    )
    return retrieve(ready, question_words(probes), k, ("recency_bonus", "update_bonus"), probe_bonus=True, classes=("update_bonus",))


def topk_submission_raw(events: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    return retrieve(with_public_words(events), question_words(probes), k, recency_key="timestamp")


def topk_submission_temporal(events: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    updated = (F.size("supersedes") > 0) | (F.size("invalidates") > 0)
    ready = (
        later_penalty(with_public_words(events))
        .withColumn("update_bonus", F.when(updated, F.lit(0.25)).otherwise(F.lit(0.0)))
        .withColumn("minus_later", -F.col("penalty"))
    )
    return retrieve(ready, question_words(probes), k, ("update_bonus", "minus_later"), recency_key="timestamp", classes=("update_bonus",))


def topk_signal_boost(events: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    return retrieve(with_public_words(events), question_words(probes), k, signal_weight=0.05, recency_key="timestamp")


def event_profile(events: DataFrame) -> DataFrame:
    """Most common repositories, labels, people, actors and signals of each project;
    equal counts keep the order of first appearance."""
    from worktrail.functions.profile_text import extract_assignees, extract_labels, workflow_signals

    def entries(dimension: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(dimension).alias("dimension"), v.alias("value"), i.alias("i")))

    content = F.col("content")
    parts = F.concat(
        entries("repos", F.array(F.coalesce(F.col("metadata")["repo"], F.lit("")))),
        entries("top_labels", extract_labels(content)),
        entries("top_assignees", extract_assignees(content)),
        entries("top_actors", F.array("actor")),
        entries("workflow_signals", workflow_signals(content)),
    )
    rows = events.select("project_id", "ord", F.explode_outer(parts).alias("e")).select("project_id", "ord", "e.*")
    counted = (
        rows.filter("value <> ''")
        .groupBy("project_id", "dimension", "value")
        .agg(F.count("*").alias("n"), F.min(F.struct("ord", "i")).alias("first_seen"))
    )
    ranked = top_rows(counted, ["project_id", "dimension"], [F.desc("n"), F.asc("first_seen")], 10, "rank")
    return ranked.filter("dimension <> 'repos' or rank <= 5").select(
        "project_id", "dimension", F.col("rank").cast("bigint").alias("rank"), "value", "n"
    )


def profile_row(profile: DataFrame) -> DataFrame:
    """Ten values at most per list."""
    names = ["repos", "top_labels", "top_assignees", "top_actors", "workflow_signals"]
    return profile.groupBy("project_id").agg(
        *[joined_list(F.col("rank"), F.col("value"), F.col("dimension") == n).alias(n) for n in names]
    )
