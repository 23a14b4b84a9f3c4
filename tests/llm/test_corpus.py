"""Each operator against a plain version, and on odd and empty tables."""

import hashlib
import html
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, forest, near, ngram, packing, pages, quality, repeats, tokencounts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- 1


def test_bpe_is_the_library(odd, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    for docs in (odd, small):
        expected = Counter()
        for i, text in pairs_of(docs):
            if text is not None and len(text) > 150_000:
                text_ids = library.encode(text, add_special_tokens=False).ids
            else:
                text_ids = library.encode(text or "", add_special_tokens=False).ids
            back = library.decode(text_ids, skip_special_tokens=False)
            expected[i, len(text_ids), hashlib.sha256(np.array(text_ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.digests(docs).collect()) == expected


def test_bpe_round_trip_and_empty(odd, none):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd)).collect()}
    assert all(back[i] == (t or "") for i, t in pairs_of(odd))
    assert bpe.digests(none).count() == 0


def test_trie_is_plain_merging():
    pairs = bpe.encoder(bpe.vocabulary_path(bpe.VOCABULARY)).pairs
    rng = np.random.default_rng(1)
    found = [bytes(rng.choice(list(b"aeinorst xyz.\xc3\xa9"), rng.integers(1, 14)).astype(np.uint8)) for _ in range(400)]
    got = pairs.encode_words(list(set(found)))
    assert all(np.frombuffer(got[w], "<u2").tolist() == pairs.merge(w) for w in found)


# ---- 2


def test_pages_keep_the_article(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in pages.extract(rows, pages.fitted()).collect()}
    for page in rows.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|b|br)>", article)]
        assert got[page.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed <b>text &amp; more"), (None, "u", "plain"), (5, "u", "<script>if (a < b) {}</script><style>x"), (6, "u", "<" * 50 + "a" * 50_000)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), pages.fitted(40)).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[5] == ""


def test_pages_without_an_end_of_head(spark):
    body = "<article>" + "".join(f"<p>Sentence number {i} of a story that goes on, with words enough to be read.</p>" for i in range(12)) + "</article>"
    top = "<!DOCTYPE html><html><head>\n<meta charset=utf-8><title>Name</title><script>x()</script><link rel=a>"
    closed = pages.blocks(f"{top}</head><body>{body}</body></html>")
    assert len(closed) == 12
    assert pages.blocks(f"{top}<body>{body}") == closed
    for start in ("", "<img src=a>", "<header></header>"):
        assert [b.text for b in pages.blocks(f"{top}{start}{body}")] == [b.text for b in closed]
    assert [b.text for b in pages.blocks(f"{top}Plain text <b>bold</b></html>")] == ["Plain text bold"]
    html = [(1, "u", f"{top}</head><body>{body}</body></html>"), (2, "u", f"{top}<body>{body}")]
    a, b = pages.extract(spark.createDataFrame(html, "page_id long, url string, html string"), pages.fitted(40)).orderBy("page_id").collect()
    assert a.text == b.text != ""


def test_labeller_on_unseen_templates():
    rng, model = np.random.default_rng(77), pages.fitted(300)
    right = total = 0
    for _ in range(100):
        page, marks = pages.written_page(rng)
        if found := pages.blocks(page):
            p = model.probabilities(model.project(np.stack([pages.path_slots(b.path) for b in found])), pages.block_vectors(found, [len(found)]), np.array([len(found)]))
            right, total = right + int(((p >= 0.5) == np.array(marks)).sum()), total + len(marks)
    assert right / total > 0.97


# ---- 3


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = defaultdict(set)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        shared = Counter(j for x in s for j in inverted[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = root(i), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].add(k)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize(("block", "dense"), [(near.BLOCK, near.DENSE), (3, 1)])
def test_near_duplicates_are_all_pairs(small, odd, none, monkeypatch, block, dense):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "DENSE", dense)
    for docs in (odd, small) if block > 3 else (odd,):
        assert sorted((tuple(r) for r in near.link(docs).collect()), key=str) == linked(pairs_of(docs))
    if block > 3:
        assert near.link(none).count() == 0


def test_near_duplicates_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(9, a), (9, b), (3, a + " x"), (5, "y " + b), (7, "alone at last")]
    assert sorted((tuple(r) for r in near.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == linked(rows)


def test_strangers_with_one_passage_leave_no_pairs(spark, monkeypatch):
    """Two thousand texts of which a passage is more than half are listed together, but no pair of them leaves a list."""
    emitted = []
    across = near._across
    monkeypatch.setattr(near, "_across", lambda *a: emitted.append(across(*a).count()) or across(*a))
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join([*passage, *(f"w{i}x{j}" for j in range(60))])) for i in range(2000)]
    rows += [(5000, rows[7][1] + " end"), (5001, " ".join(passage))]
    found = near.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in found.collect() if not r.kept} == {(5000, 7)}
    assert emitted[0] < 2000


def test_near_duplicates_in_a_chain_of_many(spark, monkeypatch):
    """A large group whose members are linked step by step, longer than a block."""
    monkeypatch.setattr(near, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for j in range(i // 3):
            text[(j * 7) % 120] = f"v{j}"
        text[(i * 11) % 120] = f"z{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near.link(docs).collect()), key=str) == linked(rows)


def test_keep_first_keeps_columns(odd):
    kept = near.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id in (6, 7, 8)").collect()) == [6]


# ---- 4


def test_token_counts_recount(odd, none, spark):
    versions = ["words-1", "runs-2", "blanks-0"]
    got = Counter((r.doc_id, r["words-1"], r["runs-2"]) for r in tokencounts.counted(odd, versions).collect())
    assert got == Counter((i, len(words(t)), len(re.findall(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]", t or ""))) for i, t in pairs_of(odd))
    assert tokencounts.counted(none, versions).count() == 0


def test_commits_are_idempotent(spark, odd, tmp_path):
    counts = tokencounts.counted(odd, ["words-1"])
    totals = tokencounts.Totals(spark, str(tmp_path / "t"))
    assert totals.read().count() == 0
    assert totals.commit("one", tokencounts.inserts(counts, "words-1"))
    once = sorted(map(str, totals.read().collect()))
    assert not totals.commit("one", tokencounts.inserts(counts, "words-1"))
    assert sorted(map(str, totals.read().collect())) == once
    assert totals.commit("two", tokencounts.deletes(counts, "words-1")) and totals.read().count() == 0
    assert totals.commit("three", tokencounts.inserts(counts.limit(0), "words-1")) and totals.batches == ["one", "two", "three"]


# ---- 5


def test_packing_is_whole_and_tight(small, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    for docs in (small, odd):
        rows = packing.pack(docs).collect()
        texts, by_doc, by_sequence = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, t in pairs_of(docs):
            texts[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
        for r in rows:
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append((r.offset, r.length))
        assert set(by_doc) == set(texts)
        for i, pieces in by_doc.items():
            if len(texts[i]) == 1:
                ids, at = texts[i][0], 0
                for p in sorted(pieces, key=lambda p: p.start):
                    assert p.start == at and p.doc_tokens == len(ids)
                    assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
                    at += p.length
                assert at == len(ids)
            else:
                assert sum(p.length for p in pieces) == sum(map(len, texts[i]))
        for spans in by_sequence.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        short = [s for s in by_sequence.values() if sum(n for _, n in s) < 2048 - packing.SLACK]
        assert len(short) <= 1
    assert packing.pack(none).count() == 0


def test_cut_texts_come_the_same_both_ways(small, monkeypatch):
    few = small.where("doc_id < 60")
    docs = few.unionByName(few.where("doc_id < 30")).cache()  # a row that occurs twice is cut twice
    sent = Counter(packing.pack(docs).collect())
    assert any(r.start % packing.WINDOW for r in sent)
    monkeypatch.setattr(packing, "SENT_CUTS", 0)
    assert Counter(packing.pack(docs).collect()) == sent


def test_plan_uses_every_tail_once():
    rng = np.random.default_rng(3)
    for histogram in (rng.integers(0, 50, 2049), np.bincount([700] * 999, minlength=2049), np.zeros(2049, np.int64)):
        histogram = histogram.copy()
        histogram[0] = 0
        plan = packing.make_plan(histogram)
        length, low, base, offset = plan.arrays()
        for n in np.flatnonzero(histogram):
            assert low[length == n].min() == 0 and (np.diff(low[length == n]) > 0).all()
        assert plan.stream <= int((histogram * np.arange(2049)).sum())


# ---- 6


def removed(rows, window=50):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_regions", [2000, 1])
def test_repeats_are_all_windows(spark, small, odd, none, monkeypatch, group_regions):
    monkeypatch.setattr(repeats, "GROUP_REGIONS", group_regions)
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    common = [f"c{i}" for i in range(64)]
    mixed = [(k, " ".join([f"{k}a{i}" for i in range(k % 7 * 9)] + common[k % 3 : 64 - k % 5] + [f"{k}b{i}" for i in range(k % 4 * 11)] + common[:56])) for k in range(40)]
    tables = [odd, spark.createDataFrame(mixed, "doc_id long, text string")] + ([small] if group_regions > 1 else [])
    for docs in tables:
        got = sorted((tuple(r) for r in repeats.remove(docs).select("doc_id", "n_words", "n_removed", digest).collect()), key=str)
        assert got == removed(pairs_of(docs))
    assert repeats.remove(none).count() == 0


# ---- 7


def test_forest_recall_and_odd_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    got = defaultdict(list)
    for r in forest.search(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q in got:
        best = sorted(((-float(np.dot(x[q], v)), i) for i, v in x.items() if i != q))[:20]
        hits.append(len({i for _, i in best} & {i for i, _ in got[q]}) / len(best))
        assert all(abs(s - float(np.dot(x[q], x[i]))) < 1e-12 for i, s in got[q])
    assert len(got) == sum(i % 20 == 0 for i in x) and np.mean(hits) >= 0.9
    bad = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (3, [2.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    odd = forest.search(spark.createDataFrame(bad, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in odd} == {(0, 3), (0, 4)} and all(r.score == 2.0 for r in odd)
    assert forest.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


# ---- 8


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        w = list(rng.choice(vocabulary, 40))
        if i % 4 == 0:
            w[5], w[11] = rng.choice(["vile", "awful", "nasty"], 2)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, docs)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97


def test_toxicity_odd(odd, none, labels, spark):
    weights = toxicity.fit(odd, labels)
    got = toxicity.score(odd, weights).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.keep_clean(odd, labels.limit(0)).columns == odd.columns


# ---- 9


def test_language_model_is_the_formula(small, odd, none):
    for docs, size in ((small, 60_000), (odd, 4_000)):
        rows = pairs_of(docs)
        texts = [(i, [*words(lower(t)), 0], zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False) for i, t in rows]
        uni, bi = Counter(), Counter()
        for _, w, held in texts:
            if not held:
                uni.update(w)
                bi.update(zip([1, *w[:-1]], w, strict=True))
        n, v, kinds = sum(uni.values()), len(uni), len(bi)
        before = Counter(b for _, b in bi)
        d = ngram.discounts(np.array([Counter(bi.values())[k] for k in (1, 2, 3, 4)]))
        e = ngram.discounts(np.array([Counter(before.values())[k] for k in (1, 2, 3, 4)]))
        spare = sum(e[min(k, 3)] for k in before.values()) / kinds
        start, weight = Counter(), Counter()
        for (a, _), c in bi.items():
            start[a] += c
            weight[a] += d[min(c, 3)]

        def low(b):
            return max(before[b] - e[min(before[b], 3)], 0) / kinds + spare / (v + 1)

        def p(a, b):
            return max(bi[a, b] - d[min(bi[a, b], 3)], 0) / start[a] + weight[a] / start[a] * low(b) if start[a] else low(b)

        assert abs(sum(low(b) for b in uni) + low("unknown") - 1) < 1e-9
        expected = sorted((str(i), held, len(w), sum(uni[b] > 0 for b in w), n, round(sum(np.log10((uni[b] + 1) / (n + v + 1)) for b in w), 5), round(sum(np.log10(p(a, b)) for a, b in zip([1, *w[:-1]], w, strict=True)), 5)) for i, w, held in texts)
        got = sorted((str(r[0]), *r[1:5], round(r[5], 5), round(r[6], 5)) for r in ngram.score(docs, size).collect())
        assert [g[:5] for g in got] == [x[:5] for x in expected]
        assert np.allclose([g[5:] for g in got], [x[5:] for x in expected], atol=1e-4)
    assert ngram.score(none).count() == 0


# ---- 10


def test_quality_statistics_are_plain_counts(small, odd, none, labels):
    for docs in (small, odd):
        expected = Counter()
        for i, t in pairs_of(docs):
            w = words(t)
            grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
            repeated = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
            seen, dups = set(), 0
            for line in (t or "").split("\n"):
                if words(line):
                    dups += line in seen
                    seen.add(line)
            failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
            expected[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dups, len(repeated), failed] += 1
        got = quality.judge(docs, quality.fit(docs, labels)).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_trees_obey_their_directions():
    from tessella.llm import gbdt

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + rng.normal(0, 0.5, 3000) > 0).astype(float)
    model = gbdt.fit(x, y, {0: 1, 1: 1})
    for j in (0, 1):
        grid = np.repeat(x[:200], 25, axis=0)
        grid[:, j] = np.tile(np.linspace(-3, 3, 25), 200)
        assert (np.diff(model.margin(grid).reshape(200, 25), axis=1) >= -1e-12).all()
    assert ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.8


# ---- the pipeline


def test_pipeline_stages_are_the_operators(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES[:4]):
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        if i == 2:
            kept = {r[0] for r in linked(pairs_of(docs)) if r[3]}
            assert {r.doc_id for r in out.collect()} == kept
        if i == 3:
            expected = {i: (n, h) for i, _, n, h in removed(pairs_of(docs))}
            assert all(repeats.digest(t) == expected[i][1] for i, t in pairs_of(out))
        docs = out
    assert pipeline.STAGES[4][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()


def test_words_are_merged_as_the_library_does():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path(packing.VOCABULARY)
    with open(path, encoding="utf-8") as f:
        merges, library = packing.Merges(json.load(f)), Tokenizer.from_file(path)
    r = random.Random(3)
    made = ["".join(r.choice("aAbBéÉßÿŸſİµªº²½0123.,-_#$%&\"()ĳŉabcdefghij漢") for _ in range(r.randint(1, 14))) for _ in range(3000)] + ["aaaaaaaa", "anan" * 9, "x" * 300]
    found = merges.encode(made)
    assert 0 < sum(x is None for x in found) < 1500
    assert all(x is None or np.frombuffer(x, "<u2").tolist() == library.encode(w, add_special_tokens=False).ids for w, x in zip(made, found, strict=True))
    assert merges.encode([]) == []


@pytest.mark.parametrize("piece", ["<a '", "<svg>", "<div>x", "<a ", "<", "<!--", "<select><option>", "<p>z", "<a>t"])
def test_blocks_of_a_page_that_never_closes(piece):
    """A time in proportion to the page: a quadratic scan of a megabyte takes hours."""
    began = time.process_time()
    pages.blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 40


def test_drop_repeats_with_names_of_its_own(odd):
    whole = {(r.doc_id, r.text_id): r for r in repeats.remove(odd).collect()}
    found = repeats.drop_repeats(odd)
    assert found.columns == odd.columns and found.count() == odd.count()
    assert {r.kept for r in found.collect()} == {"own"}
    changed = {r.doc_id: r.text for r in found.collect() if r.doc_id in (8, 10)}
    assert changed == {i: r.kept for (i, _), r in whole.items() if i in (8, 10)}
    assert near.keep_first(odd.withColumn("own_id", F.lit(1))).columns == [*odd.columns, "own_id"]


def test_byte_counts_in_blocks(monkeypatch):
    monkeypatch.setattr(quality, "_BYTES", 7)
    texts_ = [b"", b"abc", b"x" * 30, b"", b"hello world", b""]
    raw, offsets = np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0, *map(len, texts_)])
    assert (quality._byte_counts(raw, offsets) == np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts_])).all()


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1"])
def test_forest_recall_on_larger_tables(spark, at):
    folder = f"/root/testdata/{at}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = defaultdict(set)
    for r in forest.query(spark, folder).collect():
        found[r.query_id].add(r.vec_id)
    assert len(found) == (ids % 20 == 0).sum()
    hits = 0
    for q, mine in found.items():
        score = np.where(ids == q, -np.inf, x @ x[np.flatnonzero(ids == q)[0]])
        hits += len(mine & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits / (20 * len(found)) >= 0.95


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, labels, tmp_path):
    import corpus_pipeline

    for name, docs, marks in (("odd", odd.withColumn("own_id", F.lit(1)), labels), ("none", none, labels.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        marks.write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        found = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns)
        assert {r.doc_id for r in found.collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        assert name == "odd" or found.count() == 0
