"""Greedy continuation of prompts by an n-gram model learned from a corpus.

The reference asks a language model for a greedy continuation. Here the "model" is a table:
for every context of 1..k tokens seen in the training corpus, the most frequent next token
(ties: smallest token). A continuation is a walk over that table. The table is written once, in buckets of
its states; all walks then step together, and a step moves only the walks' present states: walks visit few of the states,
so nothing that grows with the table is shuffled or written per step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import detokenize, first_tokens, tokenize
from ..session import bucketed, materialized, scratch_path


#: Bytes of text whose contexts of one order a task counts, and states that a task writes. Each takes some 150 MB at most: tasks that
#: hold more spill, several times what was sent to them. A table has at most MOST_PARTS buckets.
PART_BYTES, PART_STATES, MOST_PARTS = 4 << 20, 500_000, 100_000
#: Bytes of text in a part of ``stored_texts``.
TEXT_BYTES = 32 << 20


def _parts(spark: SparkSession, amount: int, each: int) -> int:
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each)), MOST_PARTS)


def model_parts(corpus: DataFrame, orders: int = 1, text_col: str = "text") -> int:
    """Parts that a model of ``corpus`` is counted and written in: they grow with its texts and the orders of contexts, a part's rows do not."""
    size = corpus.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return _parts(corpus.sparkSession, orders * size, PART_BYTES)


def state_key(state_tokens) -> Column:
    return F.array_join(state_tokens, " ")


def last_tokens(tokens: Column, k: int) -> Column:
    """Last min(size, k) tokens."""
    return F.slice(tokens, F.greatest(F.size(tokens) - k + 1, F.lit(1)), F.least(F.size(tokens), F.lit(k)))


def context_next_pairs(tokens_df: DataFrame, k: int, tokens_col: str = "tokens", min_order: int = 1, keep=()) -> DataFrame:
    """Every (context of n tokens, next token) occurrence, n = min_order..k, as rows (*keep, state, next).

    Contexts of order n are built from those of order n-1 by zipping shifted slices, so each
    token is touched once per order (no per-position slicing).
    """
    t = F.col(tokens_col)
    size = F.size(t)
    outs = []
    prev = None
    for n in range(1, k + 1):
        m = F.greatest(size - n, F.lit(0))  # number of (context, next) pairs of order n
        cur = F.slice(t, 1, m) if prev is None else F.zip_with(
            F.slice(prev, 1, m), F.slice(t, n, m), lambda a, b: F.concat_ws(" ", a, b)
        )
        if n >= min_order:
            outs.append(F.arrays_zip(cur.alias("state"), F.slice(t, n + 1, m).alias("next")))
        prev = cur
    return tokens_df.select(*keep, F.inline(F.flatten(F.array(*outs))))


def train_next_token(corpus: DataFrame, k: int = 3, text_col: str = "text", min_order: int = 1, heads: DataFrame | None = None,
                     parts: int | None = None, row_col: str | None = None) -> DataFrame:
    """O29 (training): table ``(state STRING, next STRING, cnt BIGINT)``, one row per state.

    ``cnt`` is the count of the chosen continuation; ties go to the smallest token. Contexts of one token, which may be
    hot, are counted before the shuffle too; longer ones are sent once, by state, and counted and chosen where they arrive,
    in ``parts`` (those of ``model_parts`` unless given).
    ``min_order = k`` skips the shorter contexts when every walk starts
    from at least k tokens. With ``heads (token)`` shorter contexts are kept only if they begin with one of these:
    a walk from fewer than k tokens keeps its first token until it has k.
    With ``row_col``, a column of ``corpus``, each state also has the least one of the texts in which it goes on as chosen.
    """
    keep = [row_col] if row_col else []
    tokens = corpus.select(*keep, tokenize(text_col).alias("tokens"))
    low = min_order if heads is None else k
    single, longer = [], []
    if low == 1:
        single.append(context_next_pairs(tokens, 1, keep=keep))
    elif heads is not None:
        for found, n, least in ((single, 1, 1), (longer, k - 1, 2)):
            if n >= least:
                short = context_next_pairs(tokens, n, min_order=least, keep=keep).withColumn("token", F.get(F.split("state", " "), F.lit(0)))
                found.append(short.join(heads.select("token").distinct(), "token", "left_semi").select(*keep, "state", "next"))
    if k > 1:
        longer.append(context_next_pairs(tokens, k, min_order=max(low, 2), keep=keep))
        parts = parts or model_parts(corpus, k - max(low, 2) + 1 if heads is None else k - 1, text_col)
        longer = [reduce(DataFrame.unionByName, longer).repartition(parts, "state")]
    counts = [F.count(F.lit(1)).alias("cnt"), *[F.min(c).alias(c) for c in keep]]
    models = [_likeliest(p.groupBy("state", "next").agg(*counts), keep) for p in single + longer]
    return reduce(DataFrame.unionByName, models)


def _likeliest(counts: DataFrame, keep=()) -> DataFrame:
    best = counts.groupBy("state").agg(
        F.min(F.struct((-F.col("cnt")).alias("neg_cnt"), F.col("next").alias("next"), *keep)).alias("b")
    )
    return best.select("state", F.col("b.next").alias("next"), (-F.col("b.neg_cnt")).alias("cnt"), *[F.col(f"b.{c}").alias(c) for c in keep])


def stored_model(model: DataFrame, parts: int | None = None) -> DataFrame:
    """A model written in buckets of its states, as walks use it (``stored``). One made by ``train_next_token`` in ``parts`` lies by state already."""
    return bucketed(model, "state", "model", parts)


def text_rows(corpus: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """``(text_row, text)``: the texts as tokens with a space between, numbered and dealt by the number; and in how many parts."""
    size = corpus.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = _parts(corpus.sparkSession, size, TEXT_BYTES)
    rows = corpus.select(F.monotonically_increasing_id().alias("text_row"), detokenize(tokenize(text_col)).alias("text"))
    return rows.repartition(parts, "text_row"), parts


def stored_texts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """The ``text_rows`` written in buckets of the number. A model of them with ``row_col="text_row"`` knows a text for each state, so
    that walks can follow texts (``texts``)."""
    rows, parts = text_rows(corpus, text_col)
    return bucketed(rows, "text_row", "texts", parts)


def stored_states(model: DataFrame) -> DataFrame:
    """A model of any making dealt by its states, then written (``stored_model``)."""
    parts = _parts(model.sparkSession, model.count(), PART_STATES)
    return stored_model(model.repartition(parts, "state"), parts)


def state_at(tokens: Column, place, k: int) -> Column:
    """The state after the first ``place`` of ``tokens``."""
    return state_key(F.slice(tokens, F.greatest(place - k + 1, F.lit(1)), F.least(place, F.lit(k))))


def state_after(state: Column, token: Column, k: int) -> Column:
    return state_key(last_tokens(F.concat(F.split(state, " "), F.array(token)), k))


def dead_ends(places: Column) -> Column:
    """Stops at places where the model has no token."""
    none = {"next": "string", "text_row": "long", "said": "string", "end": "string"}
    return F.transform(places, lambda p: F.struct(p.alias("place"), *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()]))


def leave_texts(chains: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """Where the model leaves token sequences: ``(chain, stops)``.

    ``chains``: ``(chain, tokens, first INT, last INT)``. For each place from ``first`` to ``last`` the state after so many tokens is looked up in
    the model (one of ``stored_model``), all at once. A place is a stop if the model does not go on there as the sequence does:
    ``(place, next, text_row, said, end)`` with the model's token, its text, the state and the token that are found there, and the state
    they lead to; nulls where the model has none. Stops are sorted; chains of unknown states alone have no row.
    """
    row = F.col("text_row") if "text_row" in model.columns else F.lit(None).cast("long").alias("text_row")
    t = F.col("tokens")
    # A token that is null or holds a space does not outlast being part of a state.
    plain = ~F.exists(t, lambda x: x.isNull() | F.contains(x, F.lit(" ")))
    places = F.transform(F.sequence("first", "last"), lambda p: F.struct(p.alias("place"), state_at(t, p, k).alias("state"), F.when(plain, F.get(t, p)).alias("wanted")))
    asked = chains.where(F.col("first") <= F.col("last")).select("chain", "first", "last", F.inline(places)).hint("shuffle_hash")
    same = F.coalesce(F.col("next") == F.col("wanted"), F.lit(False))
    said = F.concat_ws(" ", "state", "next")
    other = F.when(~same, F.struct("place", "next", "text_row", said.alias("said"), state_after(F.col("state"), F.col("next"), k).alias("end")))
    found = asked.join(model.select("state", "next", row), "state").select("chain", "first", "last", F.when(same, F.col("place")).alias("same"), other.alias("other"))
    met = found.groupBy("chain", "first", "last").agg(F.collect_list("same").alias("same"), F.collect_list("other").alias("other"))
    left = F.array_except(F.sequence("first", "last"), F.concat("same", F.transform("other", lambda x: x["place"])))
    return met.select("chain", F.array_sort(F.concat("other", dead_ends(left))).alias("stops"))


def follow_texts(heads: DataFrame, model: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``(state, generated)``: the walks from ``heads`` ``(state, need[, seen])`` with distinct states, of ``need`` tokens where there
    are so many, or more where another walk came by with a greater need.

    Each walk is held against what follows ``seen.said`` in the text ``seen.text_row`` (of ``stored_texts``): the next states are looked up
    together, up to the place where the model leaves the text. There the model names another text. So a round takes a walk from
    text to text, and model and texts are read once a round, not once a token. Walks that meet in a state go on as one, and a state
    that was left before (of a loop, say) is not followed again: the pieces are put together at the end. Unknown states have no row.
    """
    spark, empty = heads.sparkSession, F.array().cast("array<string>")
    path, columns = scratch_path(spark, "walk-rounds"), "state string, need int, generated array<string>, end string, seen struct<text_row: bigint, said: string>"
    rounds = 0
    while most := heads.agg(F.max("need")).first()[0]:
        rounds += 1
        guess = empty
        if "seen" in heads.columns:
            heads = heads.select("state", "need", "seen.*").hint("shuffle_hash").join(texts, "text_row", "left")
            text, said = (F.concat(F.lit(" "), c, F.lit(" ")) for c in ("text", "said"))
            at = F.instr(text, said)
            rest = F.when(at > 0, F.substring(text, at + F.length(said), F.length(text)))
            guess = F.slice(F.coalesce(first_tokens(rest, most), empty), 1, F.col("need") - 1)
        chains = heads.select("state", "need", F.split("state", " ").alias("_own"), guess.alias("_guess")).select(
            F.monotonically_increasing_id().alias("chain"), "state", "need", F.concat("_own", "_guess").alias("tokens"),
            F.size("_own").alias("first"), (F.size("_own") + F.size("_guess")).alias("last"))
        chains = materialized(chains, "walk-chains")
        met = chains.join(leave_texts(chains, model, k), "chain").select(
            "state", "need", "first", "tokens", F.get("stops", F.lit(0)).alias("stop"))
        kept = F.slice("tokens", F.col("first") + 1, F.col("stop.place") - F.col("first"))
        went = met.select("state", "need", "stop", F.concat(kept, F.when(F.col("stop.next").isNotNull(), F.array("stop.next")).otherwise(empty)).alias("generated"))
        left = F.col("need") - F.size("generated")
        went.select("state", "need", "generated", F.when(left > 0, F.col("stop.end")).alias("end"), F.struct("stop.text_row", "stop.said").alias("seen")).write.parquet(f"{path}/round={rounds}")
        on = spark.read.schema(columns).parquet(f"{path}/round={rounds}").where(F.col("end").isNotNull())
        on = on.select(F.col("end").alias("state"), left.alias("need"), "seen").groupBy("state").agg(F.max("need").alias("need"), F.min("seen").alias("seen"))
        known = spark.read.schema(f"{columns}, round int").parquet(path).groupBy("state").agg(F.max("need").alias("_known"))
        heads = materialized(on.join(known, "state", "left").where(F.col("need") > F.coalesce("_known", F.lit(0))).drop("_known"), "walk-heads")
    if not rounds:
        return heads.select("state", empty.alias("generated"))
    pieces = spark.read.schema(f"{columns}, round int").parquet(path).groupBy("state").agg(F.max_by(F.struct("need", "generated", "end"), "need").alias("p"))
    walks = materialized(pieces.select("state", "p.*"), "walks")
    # Each time a walk gets what the walk from its end has so far, so that its pieces double.
    while not walks.where(F.col("end").isNotNull()).isEmpty():
        after = walks.select(F.col("state").alias("end"), F.col("generated").alias("_after"), F.col("end").alias("_end"))
        whole = walks.join(after, "end", "left").select("state", "need", F.concat("generated", F.coalesce("_after", empty)).alias("generated"), "_end")
        walks = materialized(whole.select("state", "need", F.slice("generated", F.lit(1), F.col("need")).alias("generated"),
                                          F.when(F.size("generated") < F.col("need"), F.col("_end")).alias("end")), "walks")
    return walks.select("state", "generated")


def greedy_walk(starts: DataFrame, model: DataFrame, k: int, stored: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """Walk the model from each start state.

    ``starts``: ``(start STRING, need INT)`` with distinct ``start``, the start state's key. Returns
    ``(start, generated ARRAY<STRING>)`` with up to ``need`` tokens; a state with no continuation ends the walk early.
    ``stored``: the model is one of ``stored_model``, else its states are counted and it is dealt by state and written first.
    With ``texts``, those of ``stored_texts`` that the model names by state, walks follow these (``follow_texts``).

    Else all walks take a step at once. A step's rows are (walk, state), written once; the token of a step is the last one of its state.
    """
    spark = starts.sparkSession
    starts = materialized(starts.select(F.monotonically_increasing_id().alias("walk"), "start", F.col("need").cast("int").alias("need")), "walk-starts")
    most = starts.agg(F.max("need")).first()[0] or 0
    if not stored and most > 0:
        model = stored_states(model)
    empty = F.coalesce("generated", F.array().cast("array<string>")).alias("generated")
    if texts is not None:
        heads = starts.where("start is not null and need > 0").select(F.col("start").alias("state"), "need")
        walked = follow_texts(heads, model, texts, k).withColumnRenamed("state", "start")
        return starts.join(walked, "start", "left").select("start", empty, "need").select("start", F.slice("generated", F.lit(1), F.col("need")).alias("generated"))
    after = state_after(F.col("state"), F.col("next"), k)
    path, columns = scratch_path(spark, "walk-steps"), "walk long, need int, state string"
    at = starts.select("walk", "need", F.col("start").alias("state"))
    step = 0
    while step < most and not at.isEmpty():
        step += 1
        going = at.where(F.col("need") >= step).hint("shuffle_hash")
        going.join(model.select("state", "next"), "state").select("walk", "need", after.alias("state")).write.parquet(f"{path}/step={step}")
        at = spark.read.schema(columns).parquet(f"{path}/step={step}")
    if not step:
        return starts.select("start", F.array().cast("array<string>").alias("generated"))
    token = F.element_at(F.split("state", " "), -1)
    walked = spark.read.schema(f"{columns}, step int").parquet(path).select("walk", F.struct("step", token.alias("token")).alias("at"))
    walked = walked.groupBy("walk").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["token"]).alias("generated"))
    return starts.join(walked, "walk", "left").select("start", empty)


def greedy_complete(prompts: DataFrame, model: DataFrame, k: int, context_col: str, need, stored: bool = False,
                    texts: DataFrame | None = None) -> DataFrame:
    """O29 (generation): add ``generated ARRAY<STRING>`` to ``prompts``.

    ``need`` is an int or a column name with the number of tokens to generate per row.
    Walks are computed once per distinct start state (copies share them) and sliced back.
    """
    need_col = F.lit(need) if isinstance(need, int) else F.col(need)
    with_start = prompts.withColumn("_start", state_key(last_tokens(F.col(context_col), k))).withColumn("_need", need_col.cast("int"))
    starts = with_start.groupBy(F.col("_start").alias("start")).agg(F.max("_need").alias("need"))
    walks = greedy_walk(starts, model, k, stored, texts)
    joined = with_start.join(walks.withColumnRenamed("start", "_start"), "_start", "left")
    return joined.withColumn(
        "generated", F.slice(F.coalesce(F.col("generated"), F.array().cast("array<string>")), 1, F.col("_need"))
    ).drop("_start", "_need")


def attach_completions(samples: DataFrame, completions: DataFrame, key: str, completion_col: str = "completion") -> DataFrame:
    """Completions produced elsewhere (e.g. by a model service) joined on the sample key."""
    return samples.join(completions.select(key, completion_col), key, "left")
