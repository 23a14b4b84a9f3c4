"""Sentences, candidates for concepts, their scores, gates and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T

#: Sentences that are compared with all concepts at once.
SLICE = 512
#: Phrases that make a sentence look like one of a kind.
CUES = {
    "definition": [" is a ", " is an ", " is the ", " defined as ", " refers to ", " denotes ", " we call ", " called ", " means "],
    "procedure": ["algorithm", "compute", "else", "for each", "if", "input", "invoke", "output", "pick", "procedure", "repeat", "select", "set", "split", "step", "then", "until"],
    "example": ["consider", "e.g.", "example", "for example", "for instance", "suppose"],
    "transition": ["after that", "before we", "finally", "in the following", "let us", "next", "now", "recall", "remember", "we now", "we will"],
    "navigation": [
        "agenda", "appendix", "block", "chapter", "closing", "contents", "exercise", "exercises", "next", "outline", "overview", "previous", "question", "questions",
        "recall", "recap", "references", "running example", "section", "summary", "thank you", "topic", "unit",
    ],
    "affiliation": ["chair", "department", "faculty", "institute", "professor", "school", "university"],
}


def flags(s: Column) -> dict[str, Column]:
    """Boolean columns, one for each kind of sentence."""
    low, tokens = F.lower(s), F.size(T.index_tokens(s))
    out = {f"is_{k}": _any(low, v) for k, v in CUES.items()}
    out["is_heading"] = (tokens <= 14) & ~s.rlike(r"[.!?]$")
    out["is_formula"] = s.rlike(r"[=<>^]|\|.*\|")
    out["is_caption"] = low.rlike(r"^(figure|table|fig\.) *[0-9]*")
    out["is_fragment"] = (tokens < 4) | s.rlike(r"^[a-z]")
    return out


def _any(low: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p))
    return found


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, sentence."""
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))


def neighbour_text(rows: DataFrame, around: int = 1) -> DataFrame:
    """Adds context: the sentence with those before and after it in its document."""
    w = W.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(-around, around)
    return rows.withColumn("context", F.array_join(F.collect_list("sentence").over(w), " "))


def candidates(sentences: DataFrame, concepts: DataFrame, least_shared: int = 3) -> DataFrame:
    """item_id, doc_id, sent_idx, shared: sentences that share enough tokens with a concept.

    Every token counts, however frequent.  Concepts are few: their tokens go to
    all workers as an inverted list, and a sentence's shared tokens are counted
    where it is read, so neither sentences nor pairs are exchanged.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens = lambda c: F.array_distinct(T.content_tokens(F.col(c))).alias("tokens")
    wanted = [r for r in concepts.select("item_id", tokens("text")).collect() if r.tokens]
    item_type, ids = concepts.schema["item_id"].dataType, list(dict.fromkeys(r.item_id for r in wanted))
    place = {item: i for i, item in enumerate(ids)}
    lists: dict[str, list[int]] = {}
    for r in wanted:
        for t in r.tokens:
            lists.setdefault(t, []).append(place[r.item_id])
    names, sizes = list(lists), np.array([len(v) for v in lists.values()], dtype=np.int64)
    flat, starts = np.array([i for v in lists.values() for i in v], dtype=np.int64), np.cumsum(sizes) - sizes

    def run(batches):
        known = pa.array(names, pa.string())
        for batch in batches if names else ():
            items = pa.array(ids, batch.schema.field("item_type").type)
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = pc.index_in(pc.list_flatten(part["tokens"]), value_set=known)
                row = pc.list_parent_indices(part["tokens"]).to_numpy()[found.is_valid().to_numpy(zero_copy_only=False)]
                token = found.drop_null().to_numpy()
                n = sizes[token]
                entry = np.arange(n.sum()) + np.repeat(starts[token] - np.cumsum(n) + n, n)
                pair, shared = np.unique(np.repeat(row.astype(np.int64), n) * len(ids) + flat[entry], return_counts=True)
                pair, shared = pair[shared >= least_shared], shared[shared >= least_shared]
                kept = part.take(pa.array(pair // len(ids)))
                yield pa.RecordBatch.from_arrays([items.take(pa.array(pair % len(ids))), kept["doc_id"], kept["sent_idx"], pa.array(shared, pa.int64())], names=["item_id", "doc_id", "sent_idx", "shared"])

    rows = sentences.select("doc_id", "sent_idx", F.lit(None).cast(item_type).alias("item_type"), tokens("sentence"))
    of = lambda c: f"{c} {sentences.schema[c].dataType.simpleString()}"
    return rows.mapInArrow(run, f"item_id {item_type.simpleString()}, {of('doc_id')}, {of('sent_idx')}, shared long")


def broad_tokens(concepts: DataFrame, least_concepts: int = 4, least_parents: int = 2) -> DataFrame:
    """Tokens that many concepts of several parents share."""
    tokens = concepts.select("item_id", "parent", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_concepts"), F.countDistinct("parent").alias("n_parents")).where((F.col("n_concepts") >= least_concepts) & (F.col("n_parents") >= least_parents))


def competitors(concepts: DataFrame, k: int = 12) -> DataFrame:
    """item_id, other_id, rank: the other concepts closest by parent, then shared tokens, then id.

    Concepts are few; pairs are made by an equi-join on shared tokens and one on
    the parent, so concepts with neither in common are never paired.
    """
    tokens = concepts.select("item_id", "parent", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("token"))
    shared = tokens.alias("a").join(tokens.alias("b"), F.col("a.token") == F.col("b.token")).where("a.item_id <> b.item_id")
    shared = shared.groupBy(F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("other_id")).agg(F.count(F.lit(1)).alias("shared"))
    family = siblings(concepts).select("item_id", "other_id", F.lit(1).alias("same"))
    both = shared.join(family, ["item_id", "other_id"], "full_outer").select("item_id", "other_id", F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("shared", F.lit(0)).alias("shared"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("same"), F.desc("shared"), "other_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def siblings(concepts: DataFrame) -> DataFrame:
    """item_id, other_id with one parent."""
    other = concepts.select(F.col("item_id").alias("other_id"), "parent")
    return concepts.select("item_id", "parent").join(other, "parent").where("item_id <> other_id").select("item_id", "other_id")


def margins(scores: DataFrame, owner: str) -> DataFrame:
    """Each target's score against the best other concept on the same sentence: other_id, margin.

    scores: item_id, doc_id, sent_idx and the column named ``owner``.
    """
    key = ["doc_id", "sent_idx"]
    best = F.struct(F.col(owner).alias("s"), (-F.col("item_id")).alias("i"))
    ranked = scores.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(best.desc())))
    first = ranked.where("place = 1").select(*key, F.col("item_id").alias("first_id"), F.col(owner).alias("first"))
    second = ranked.where("place = 2").select(*key, F.col("item_id").alias("second_id"), F.col(owner).alias("second"))
    rows = scores.join(first, key).join(second, key, "left")
    is_first = F.col("item_id") == F.col("first_id")
    rival, rival_id = F.when(is_first, F.col("second")).otherwise(F.col("first")), F.when(is_first, F.col("second_id")).otherwise(F.col("first_id"))
    return rows.select(*key, "item_id", owner, rival_id.alias("other_id"), (F.col(owner) - F.coalesce(rival, F.lit(0))).alias("margin"))


def role_scores(s: Column) -> Column:
    """Scores of the roles a sentence can play, and the role that leads; ties in alphabetical order."""
    f = flags(s)
    value = lambda **w: sum((F.when(f[f"is_{k}"], v).otherwise(0.0) for k, v in w.items()), F.lit(0.0))
    return F.struct(
        value(definition=3.0, example=-0.5, fragment=-1.0).alias("definition"),
        value(procedure=2.5, formula=0.5).alias("procedure"),
        value(example=2.5).alias("example"),
        value(formula=2.0, fragment=0.25).alias("formula"),
        value(navigation=2.0, heading=1.0, affiliation=2.0, transition=1.0).alias("context"),
    )


def leading_role(scores: Column, least: float = 1.0, clear: float = 0.9) -> Column:
    """The best role, "ambiguous" if the next is close, "none" if none is good enough."""
    names = ["context", "definition", "example", "formula", "procedure"]
    # array_sort is ascending: negated scores put the best first, names break ties.
    ordered = F.array_sort(F.array(*(F.struct((-scores[n]).alias("s"), F.lit(n).alias("n")) for n in names)))
    first, second = ordered[0], ordered[1]
    return F.when(-first["s"] < least, "none").when(-first["s"] + second["s"] < clear, "ambiguous").otherwise(first["n"])


def admission(f: dict[str, Column], shared: Column, usage: Column) -> Column:
    """One of five decisions, by the first rule that holds."""
    return (
        F.when(f["is_affiliation"] | f["is_navigation"], "reject")
        .when(f["is_fragment"] & ~f["is_formula"], "reject")
        .when(usage >= 3, "review")
        .when(f["is_formula"], "auxiliary_context")
        .when(f["is_definition"] & (shared >= 4), "definition_kernel")
        .when(shared >= 4, "ordered_evidence")
        .otherwise("review")
    )


def text_usage(rows: DataFrame) -> DataFrame:
    """How many concepts use each text, whatever document it is in: print, n_concepts."""
    return rows.groupBy("print").agg(F.countDistinct("item_id").alias("n_concepts"))


def capped(rows: DataFrame, group: str, role: str, order: list[Column], caps: dict[str, int], total: int) -> DataFrame:
    """The best rows of each group under a cap for each role and one for all."""
    limit = F.lit(0)
    for name, cap in caps.items():
        limit = F.when(F.col(role) == name, cap).otherwise(limit)
    rows = rows.withColumn("in_role", F.row_number().over(W.partitionBy(group, role).orderBy(*order))).where(F.col("in_role") <= limit)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= total)


def within_budget(lengths: Column, budget: int) -> Column:
    """Which items of an array of lengths fit: one that would overflow is skipped, later ones may still fit; the first always does."""
    step = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("keep")),
        lambda a, n: F.struct(
            F.when((F.size(a["keep"]) == 0) | (a["used"] + n <= budget), a["used"] + n).otherwise(a["used"]).alias("used"),
            F.concat(a["keep"], F.array((F.size(a["keep"]) == 0) | (a["used"] + n <= budget))).alias("keep"),
        ),
    )
    return step["keep"]


def n_within_budget(lengths: Column, budget: int) -> Column:
    """How many items ``within_budget`` keeps, without an array that grows with them."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("kept"))
    fits = lambda a, n: (a["kept"] == 0) | (a["used"] + n <= budget)
    return F.aggregate(lengths, start, lambda a, n: F.struct(F.when(fits(a, n), a["used"] + n).otherwise(a["used"]).alias("used"), F.when(fits(a, n), a["kept"] + 1).otherwise(a["kept"]).alias("kept")))["kept"]


def greedy_pack(rows: DataFrame, per_page: int = 2, size: int = 8, tolerance: float = 0.05) -> DataFrame:
    """item_id, rank, doc_id, sent_idx: taken one at a time; among those within ``tolerance`` of the best, the page used least so far wins.

    Order-dependent, so it runs once for each concept over its candidates;
    those are cut to what the shortlist keeps beforehand, a bound of its own.
    """
    import pandas as pd

    def run(data: pd.DataFrame) -> pd.DataFrame:
        left = data.sort_values(["score", "doc_id", "sent_idx"], ascending=[False, True, True]).to_dict("records")
        used: dict[int, int] = {}
        out = []
        while left and len(out) < size:
            edge = left[0]["score"] - tolerance
            pool = [r for r in left if r["score"] >= edge]
            best = min(pool, key=lambda r: (used.get(r["doc_id"], 0), -r["score"], r["doc_id"], r["sent_idx"]))
            left.remove(best)
            if used.get(best["doc_id"], 0) >= per_page:
                continue
            used[best["doc_id"]] = used.get(best["doc_id"], 0) + 1
            out.append((best["item_id"], len(out) + 1, best["doc_id"], best["sent_idx"], best["score"]))
        return pd.DataFrame(out, columns=["item_id", "rank", "doc_id", "sent_idx", "score"])

    return rows.select("item_id", "doc_id", "sent_idx", "score").groupBy("item_id").applyInPandas(run, "item_id long, rank int, doc_id long, sent_idx int, score double")


def greedy_distinct(rows: DataFrame, group: str, order: str, aliases: str) -> DataFrame:
    """An item goes if any of its aliases was seen; the aliases of those that go don't count as seen.  One group at a time."""
    import pandas as pd

    def run(data: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        keep = []
        for names in data.sort_values(order)[aliases]:
            names = set(names)
            keep.append(not names & seen)
            if keep[-1]:
                seen |= names
        return data.sort_values(order).assign(kept=keep)[[group, order, "kept"]]

    return rows.select(group, order, aliases).groupBy(group).applyInPandas(run, f"{group} long, {order} long, kept boolean")
