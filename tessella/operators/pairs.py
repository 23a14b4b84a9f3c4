"""Sentences with the concepts that they may support, and what tokens the two share; counted where a sentence is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

#: Counters of sentences and concepts that are held at once.
CELLS = 1 << 20


def dealt(docs: DataFrame) -> DataFrame:
    """The same rows in several parts for each core: a file of one row group, however large, would be read and worked on by one task."""
    spark = docs.sparkSession
    return docs.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def sentence_rows(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the columns named, sent_idx, sentence and context (the sentence with its neighbours); no join, so no row is moved."""
    rows = docs.where("doc_id is not null").select("doc_id", *kept, T.sentences(F.col("text")).alias("parts"))
    empty = F.array(F.lit(None).cast("string"))
    before = F.concat(empty, F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))))
    after = F.concat(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), empty)
    around = rows.select("doc_id", *kept, F.arrays_zip(before.alias("b"), F.col("parts").alias("s"), after.alias("a")).alias("parts"), F.size("parts").alias("n"))
    rows = around.where("n > 0").select("doc_id", *kept, F.posexplode("parts").alias("sent_idx", "p"))
    return rows.select("doc_id", *kept, "sent_idx", F.col("p.s").alias("sentence"), F.concat_ws(" ", "p.b", "p.s", "p.a").alias("context"))


def only_known(tokens: Column, concepts: DataFrame, wanted: Column) -> Column:
    """Those tokens that some concept has, once each: a document's tokens are few when its sentences carry them."""
    known = [r.t for r in concepts.select(F.explode(wanted).alias("t")).distinct().collect()]
    return F.array_intersect(tokens, F.split(F.lit(" ".join(sorted(known))), " "))


def close_forms(token: str) -> list[str]:
    """All tokens that ``matching.close_tokens`` calls close to this one."""
    out = [token]
    if len(token) >= 6:
        out.append(token + token[-1])
    if len(token) >= 7 and token[-1] == token[-2]:
        out.append(token[:-1])
    return out


def matched(
    rows: DataFrame, concepts: DataFrame, counts: dict[str, tuple[Column, str]], runs: dict[str, tuple[Column, str]] | None = None, least: int = 3, drop: tuple[str, ...] = (), close: tuple[str, ...] = ()
) -> DataFrame:
    """Rows with at least one concept, once each, and ``found``: structs of item_id, all counts and runs.

    counts: name -> (tokens of a concept, name of a column of tokens of a row):
    how many distinct tokens they share; the first tells which pairs are found,
    those that share ``least``.  ``n_<name>`` is the concept's number of tokens.
    runs: name -> the same: whether the concept's tokens stand side by side in
    the row's.  Those named in ``close`` take close tokens for equal.  Columns in
    ``drop`` don't come back.  Concepts are few and go to all workers.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    runs = runs or {}
    fields = [(n, F.array_distinct(c)) for n, (c, _) in counts.items()] + [(n, c) for n, (c, _) in runs.items()]
    wanted = [r for r in concepts.where("item_id is not null").select("item_id", *(c.alias(n) for n, c in fields)).collect() if r[next(iter(counts))]]
    item_type, ids = concepts.schema["item_id"].dataType, [r.item_id for r in wanted]
    if len(set(ids)) < len(ids):
        raise ValueError("concepts have one item_id twice")
    kept, n_items = [c for c in rows.columns if c not in drop], len(ids)
    forms = lambda name, t: close_forms(t) if name in close else [t]
    columns = {c: {} for _, c in (*counts.values(), *runs.values())}  # column -> token -> its number

    def number(column: str, token: str) -> int:
        return columns[column].setdefault(token, len(columns[column]))

    def inverted(entries: list[tuple[int, int]], n: int):
        entries.sort()
        sizes = np.bincount(np.array([t for t, _ in entries], dtype=np.int64), minlength=n)
        return sizes, np.cumsum(sizes) - sizes, np.array([x for _, x in entries], dtype=np.int64)

    slots = {n: [(number(c, f), s) for s, (i, t) in enumerate((i, t) for i, r in enumerate(wanted) for t in r[n] or []) for f in forms(n, t)] for n, (_, c) in counts.items()}
    owners = {n: np.array([i for i, r in enumerate(wanted) for _ in r[n] or []], dtype=np.int64) for n in counts}
    chains = {n: [[[number(c, f) for f in forms(n, t)] for t in r[n] or []] for r in wanted] for n, (_, c) in runs.items()}
    lists = {n: inverted(slots[n], len(columns[c])) for n, (_, c) in counts.items()}
    starts = {n: inverted([(f, i) for i, chain in enumerate(chains[n]) if chain for f in chain[0]], len(columns[c])) for n, (_, c) in runs.items()}
    lengths = {n: np.array([len(x) for x in chains[n]], dtype=np.int64) for n in runs}
    names = {c: list(v) for c, v in columns.items()}
    column_of = {n: c for n, (_, c) in (*counts.items(), *runs.items())}
    count_names, run_names = list(counts), list(runs)

    def table_of(chain):
        longest = max((len(x) for x in chain), default=0)
        out = np.full((len(chain), longest, 3), -2, dtype=np.int64)
        for i, x in enumerate(chain):
            for j, f in enumerate(x):
                out[i, j, : len(f)] = f
        return out

    tables = {n: table_of(chains[n]) for n in runs}

    def expanded(token, index):
        """Places in ``token``, and an entry of the index for each."""
        sizes, first, entries = index
        n = sizes[token]
        at = np.arange(n.sum()) + np.repeat(first[token] - np.cumsum(n) + n, n)
        return np.repeat(np.arange(len(token)), n), entries[at]

    def run(batches):
        step = max(1, min(4096, CELLS // max(n_items, 1)))
        for batch in batches if n_items else ():
            items = pa.array(ids, batch.schema.field("item_type").type)
            every = {}
            for c, words in names.items():
                row = pc.list_parent_indices(batch[c]).to_numpy().astype(np.int64)
                token = pc.fill_null(pc.index_in(pc.list_flatten(batch[c]), value_set=pa.array(words, pa.string())), -1).to_numpy().astype(np.int64)
                known = np.flatnonzero(token >= 0)
                # A token of a row once: sets are compared.
                key = np.unique(row[known] * len(words) + token[known]) if len(words) else row[:0]
                every[c] = (row, token, *np.divmod(key, max(len(words), 1)))
            for at in range(0, batch.num_rows, step):
                n_rows = min(step, batch.num_rows - at)

                def count(name, at=at, n_rows=n_rows):
                    _, _, row, token = every[column_of[name]]
                    low, high = np.searchsorted(row, (at, at + n_rows))
                    place, slot = expanded(token[low:high], lists[name])
                    row = row[low:high][place] - at
                    if name in close:
                        row, slot = np.divmod(np.unique(row * len(owners[name]) + slot), max(len(owners[name]), 1))
                    return np.bincount(row * n_items + owners[name][slot], minlength=n_rows * n_items)

                def in_row(name, at=at, n_rows=n_rows):
                    row, token, _, _ = every[column_of[name]]
                    low, high = np.searchsorted(row, (at, at + n_rows))
                    row, token = row[low:high] - at, token[low:high]
                    place = np.flatnonzero(token >= 0)
                    which, item = expanded(token[place], starts[name])
                    place = place[which]
                    size = lengths[name][item]
                    fits = place + size <= np.searchsorted(row, row[place], side="right")
                    place, item, size = place[fits], item[fits], size[fits]
                    for j in range(1, tables[name].shape[1]):
                        goes = size <= j
                        more = ~goes
                        goes[more] = (tables[name][item[more], j] == token[place[more] + j][:, None]).any(axis=1)
                        place, item, size = place[goes], item[goes], size[goes]
                    out = np.zeros(n_rows * n_items, dtype=bool)
                    out[row[place] * n_items + item] = True
                    return out

                shared = count(count_names[0])
                cell = np.flatnonzero(shared >= least)
                if not len(cell):
                    continue
                item = cell % n_items
                own, sizes = np.unique(cell // n_items, return_counts=True)
                out = [items.take(pa.array(item))]
                for i, name in enumerate(count_names):
                    out += [pa.array((shared if i == 0 else count(name))[cell].astype(np.int32)), pa.array(np.bincount(owners[name], minlength=n_items)[item].astype(np.int32))]
                out += [pa.array(in_row(name)[cell]) for name in run_names]
                struct = pa.StructArray.from_arrays(out, names=of_struct)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), struct)
                part = batch.take(pa.array(own + at))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), found], names=[*kept, "found"])

    of_struct = ["item_id", *(x for n in counts for x in (n, f"n_{n}")), *runs]
    types = [item_type.simpleString(), *("int" for _ in counts for _ in range(2)), *("boolean" for _ in runs)]
    struct = ",".join(f"{n}:{t}" for n, t in zip(of_struct, types, strict=True))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.withColumn("item_type", F.lit(None).cast(item_type)).mapInArrow(run, f"{schema}, found array<struct<{struct}>>")


def by_pair(rows: DataFrame, *drop: str) -> DataFrame:
    """One row for each concept that was found in a row; adds best (the most that one of them shares) and n_use (how many there are)."""
    rows = rows.withColumn("best", F.array_max("found.shared")).withColumn("n_use", F.size("found").cast("long"))
    return rows.select(*(c for c in rows.columns if c not in ("found", *drop)), F.inline("found"))


def apart(rows: DataFrame, column: str) -> DataFrame:
    """The same rows; what comes before and after is compiled apart.

    All that is done to a row between two exchanges goes into one generated
    method, and the JVM only interprets methods of more than 8,000 bytes.
    A fold runs outside of that method: here one over a single element, which
    leaves ``column`` as it is.
    """
    return rows.withColumn(column, F.aggregate(F.array(F.lit(0)), F.col(column), lambda kept, _: kept))
