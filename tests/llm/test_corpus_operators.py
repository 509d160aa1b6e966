"""Every corpus operator on awkward rows and on a given table, against brute force."""

import hashlib
import itertools
import os
import pathlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures_llm import (PASSAGE, SCHEMA, awkward_texts, ascii_lower, base_secrets, fold, frame, jaccard_components,
                          line_report, sha, shingles, window_entropy, words)
from pyspark.sql import functions as F

from riskloom.llm import (bpe, components, embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join, quality, runs,
                          secret_scan, substring_dedup, toxicity)
from riskloom.llm.queries import QUERIES
from riskloom.session import scratch_path

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def some(value):
    return (value is None, value if value is not None else 0)


# --- 7: exact dedup

def exact_brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[ascii_lower(t)].append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[ascii_lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(ascii_lower(t))))
    return Counter(out)


def test_exact_dedup(spark, docs, rows, given):
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == exact_brute(rows)
    assert Counter(map(tuple, QUERIES["op7_exact_dedup"](spark, SF).collect())) == exact_brute(given)


def test_exact_dedup_runs_no_python(spark, docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_exact_dedup_hot_text(spark):
    rows = [(i, "Same TEXT" if i % 3 == 0 else f"own {i}", "a") for i in range(900)]
    assert Counter(map(tuple, exact_dedup.exact_dedup(frame(spark, rows)).collect())) == exact_brute(rows)


# --- 4: line dedup

def test_line_dedup(spark, docs, rows, given):
    got = Counter(tuple(r) for r in line_dedup.line_dedup_report(docs).collect())
    assert got == Counter(line_report(rows))
    got = Counter(tuple(r) for r in QUERIES["op4_line_dedup"](spark, SF).collect())
    assert got == Counter(line_report(given))


def test_line_dedup_drop_keeps_columns_and_clean_rows(spark, docs, rows):
    out = line_dedup.drop_lines(docs)
    assert out.schema.names == SCHEMA.names
    left = {r.doc_id: r.text for r in out.where("doc_id >= 100").collect()}
    assert left[101] == "own 1\n" and left[205] == "nearly shared\nown 5"
    assert out.where("doc_id < 100").count() == sum(i is not None and i < 100 for i, *_ in rows)


def test_first_rule_keeps_earliest(spark):
    rows = [(3, "a\nb", "x"), (1, "b\nc\nb", "x"), (2, "a", "x"), (2, "a", "x")]
    out = Counter((r.doc_id, r.n_dropped) for r in line_dedup.line_dedup_report(frame(spark, rows), rule="first").collect())
    assert out == Counter({(1, 1): 1, (2, 0): 2, (3, 2): 1})


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_runs_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([0, 0, 0, *range(30)]), 0, rng.randrange(40), rng.randrange(6)) for _ in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.createDataFrame(rows, "h1 long, h2 long, doc long, pos long")
        heads = {}
        held = defaultdict(set)
        for h, _, d, p in rows:
            heads[h] = min(heads.get(h, (d, p)), (d, p))
            held[h].add(d)
        later = Counter(map(tuple, runs.later_occurrences(df, []).collect()))
        assert later == Counter(r for r in rows if heads[r[0]] != (r[2], r[3]))
        often = Counter(map(tuple, runs.frequent_occurrences(df, 25, []).collect()))
        assert often == Counter(r for r in rows if len(held[r[0]]) >= 25)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


# --- components

def test_components_on_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (5000, 5000)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


# --- 1: n-gram join

def test_ngram_join(spark, docs, rows, given):
    for df, data in ((docs, rows), (spark.read.parquet(f"{SF}/documents.parquet"), given)):
        want = jaccard_components(data)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect())
        assert got == Counter((i, len(shingles(t)), want.get(i)) for i, t, *_ in data)


def near_group(seed, n, length):
    """Edited copies of a text and of its copies, so that links are near the threshold and chains form."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(10_000)}" for _ in range(length)]]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(0, max(2, length // 40))):
            at = rng.randrange(len(t))
            t[at:at + rng.randrange(0, 2)] = [f"w{rng.randrange(10_000)}"][:rng.randrange(0, 2)]
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("chunk", [None, 400])
def test_ngram_join_on_dense_groups(spark, chunk):
    texts = near_group(1, 60, 120) + near_group(2, 40, 25) + near_group(3, 30, 9) + near_group(4, 20, 400)
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    random.Random(9).shuffle(rows)
    want = jaccard_components(rows)
    old = ngram_join.CHUNK_SHINGLES
    ngram_join.CHUNK_SHINGLES = chunk or old  # small chunks force the recursion and the pairs of chunks
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(frame(spark, rows), chunk_shingles=chunk).collect()}
    finally:
        ngram_join.CHUNK_SHINGLES = old
    assert got == want


def test_ngram_join_keeps_no_sketches(spark, docs):
    scratch = pathlib.Path(scratch_path(spark, "llm"))
    before = set(scratch.glob("*")) if scratch.exists() else set()
    ngram_join.ngram_components(docs).collect()
    left = {p.name.split("-")[0] for p in set(scratch.glob("*")) - before}
    assert "sets" in left and "sketches" not in left


def test_no_set_travels_for_a_pivot_itself(spark):
    sets = spark.createDataFrame([(i, 3, np.array([1, 2, i], np.uint64).tobytes()) for i in (5, 6, 7)], "doc long, n long, set binary")
    pairs = spark.createDataFrame([(5, 5, 5), (5, 5, 6), (7, 7, 7)], "region long, pivot long, doc long")
    out = ngram_join._distances(pairs, sets)
    assert {tuple(r) for r in out.collect()} == {(5, 5, 5, 3, 3, 3), (5, 5, 6, 3, 2, 4), (7, 7, 7, 3, 3, 3)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (doc" in plan and plan.count("Union") == 1


def test_linked_sets_always_share_a_published_segment():
    limits, rng = ngram_join.Threshold(85), np.random.default_rng(3)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
            change = limits.most_changes(len(a))
            for _ in range(20):  # any edit that keeps the link
                drop, add = rng.integers(0, change + 1), rng.integers(0, change + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2 ** 63, add).astype(np.uint64))))
                inter = len(np.intersect1d(a, b))
                if limits.linked(inter, len(a) + len(b) - inter):
                    assert np.intersect1d(ngram_join.published(a, limits), ngram_join.published(b, limits)).size


def test_pipeline_stage_keeps_one_of_a_group(spark, docs):
    out = ngram_join.keep_one_per_component(docs)
    assert out.schema.names == SCHEMA.names
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert {1, 2, 3, 9, 14} <= set(ids) and not {10, 11} & set(ids) and ids.count(None) == 3


# --- 2: byte-level BPE

@pytest.fixture(scope="module")
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY),
                             special_tokens={})


def test_bpe_round_trip(spark, docs, rows, given, reference_encoding):
    def want(data):
        out = []
        for i, t, *_ in data:
            ids = reference_encoding.encode_ordinary(t or "")
            out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or ""), True))
        return Counter(out)

    assert Counter(map(tuple, bpe.round_trip(docs, VOCABULARY).collect())) == want(rows)
    assert Counter(map(tuple, QUERIES["op2_byte_bpe"](spark, SF).collect())) == want(given)


def test_bpe_encode_and_decode_columns(docs, rows, reference_encoding):
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), VOCABULARY), VOCABULARY).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in out) == Counter(
        (i, tuple(reference_encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_pieces_and_every_character(name):
    ranks = bpe.read_ranks(public_tokenizers.path(name))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = [f"a{chr(c)} b {chr(c)}1{chr(c)}{chr(c)} . {chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice(a) for _ in range(n)) for n in (1, 2, 5, 40, 3000) for a in ("ab", "a", " \n\t\r", "é漢z", "'sltm ", "-=#")
              for _ in range(8)]
    texts += ["", "a  b   c \n d  ", "x" * 30_000]
    assert encoder.encode(texts) == [own.encode_ordinary(t) for t in texts]


def test_rank_queue_pops_in_order():
    rng, queue = random.Random(4), bpe.RankQueue(50_000)
    pushed = [rng.randrange(50_000) for _ in range(3000)]
    for i, r in enumerate(pushed):
        queue.push(r, i)
    popped = []
    while (top := queue.pop()) is not None:
        popped += [top[0]] * len(top[1])
    assert popped == sorted(pushed)


def test_strict_order_when_a_merge_makes_a_lower_rank():
    letters = {bytes([b]): 1000 + b for b in range(256)}
    ranks = letters | {b"cd": 5, b"ab": 9, b"abcd": 3, b"cdab": 2}
    own = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.Vocabulary(ranks)
    for n in range(1, 6):
        for piece in map("".join, itertools.product(("ab", "cd", "a", "d"), repeat=n)):
            ids, cuts = vocabulary.encode_pieces([piece.encode(), b"zz"])
            assert ids[:cuts[1]] == own.encode_ordinary(piece)


# --- 3: mixing

def test_mixing_targets_share_the_excess():
    assert mixing.targets([]) == []
    got = mixing.targets([10, 1000, 500])
    assert got[0] == 30 and abs(sum(got) - 1510) < 1e-6 and abs(got[1] / got[2] - 2) < 1e-9


def mix_brute(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else left * weights[s] / total
        left -= sum(target[s] for s in over)
        free -= over or set(free)
    return size, target


def test_mixing(spark, docs, rows, given):
    for df, data in ((docs, rows), (spark.read.parquet(f"{SF}/documents.parquet"), given)):
        size, target = mix_brute(data)
        got = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(5)).collect()
        assert sorted(map(tuple, got), key=lambda r: tuple(map(some, r))) == sorted(map(tuple, again), key=lambda r: tuple(map(some, r)))
        source = defaultdict(list)
        for i, t, s in data:
            source[(i, len(words(t)), size[s])].append(s)
        assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter(
            (i, len(words(t)), size[s]) for i, t, s in data)
        taken, goal = Counter(), {}
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            s = source[(r.doc_id, r.size, r.source_size)]
            assert any(abs(r.target - target[x]) < 1e-6 * max(1, target[x]) for x in s)
            taken[round(r.target, 3), r.source_size] += r.taken
            goal[round(r.target, 3), r.source_size] = r.target
        for key, want in goal.items():
            same = sum(1 for s in size if (round(target[s], 3), size[s]) == key)
            assert abs(taken[key] - same * want) <= max(same * 2 * mixing.BLOCK_WORDS, 0.02 * want)


def test_mixed_documents_hold_the_words_that_the_mix_takes(spark, docs, rows):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_documents(docs)
    assert out.schema.names == SCHEMA.names
    held = Counter()
    for r in out.collect():
        held[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert +held == +taken


@pytest.mark.parametrize("name", ["mixing", "line_dedup"])
def test_texts_cut_in_tasks_are_given_back(spark, tmp_path, monkeypatch, name):
    seen, module = str(tmp_path / "seen"), {"mixing": mixing, "line_dedup": line_dedup}[name]
    monkeypatch.setattr(module, "give_back", lambda: open(seen, "a").close())
    rows = frame(spark, [(i, f"the same line\nown line {i}", "a") for i in range(12)])
    out = mixing.mixed_documents(rows) if name == "mixing" else line_dedup.drop_lines(rows)
    assert out.select("text").collect() and os.path.exists(seen)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 77)) == list(range(n))
    assert (mixing.permute(np.arange(1000), 1000, 1) != mixing.permute(np.arange(1000), 1000, 2)).any()


def test_shards_draw_the_exact_totals():
    slots = np.array([700, 0, 41, 5000], np.int64)
    shards = -(-int(slots.sum()) // 128)
    seen = np.zeros(4, np.int64)
    for s in range(shards):
        here, before = mixing.shard_draw(s, shards, slots, 128, 3)
        assert (before == seen).all() and here.sum() == min(128, slots.sum() - 128 * s)
        seen += here
    assert (seen == slots).all()


# --- 6: secrets

def test_secret_scan(spark, docs, rows, given):
    kinds = ("assign", "access", "hex")
    for df, data in ((docs, rows), (spark.read.parquet(f"{SF}/documents.parquet"), given)):
        want = Counter()
        for i, t, *_ in data:
            base = base_secrets(t)
            joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
            want[i, *(sum(k == n for _, k, _ in base) for n in range(3)), sha(joined)] += 1
        got = secret_scan.secret_scan(df).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        for r in got:  # base spans stay, the method only adds
            kept = [s for s in r.spans.split(",") if s and not s.startswith("entropy")]
            assert sha(",".join(kept)) == r.base_sha256


def test_entropy_windows_match_recounting():
    rng = random.Random(8)
    for alphabet in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCdefGHI+/0123456789xyzQRS"):
        for n in (20, 21, 45):
            s = "".join(rng.choice(alphabet) for _ in range(n))
            covered = set()
            for i in range(n - 19):
                w = s[i:i + 20]
                up, low = any(c.isupper() for c in w), any(c.islower() for c in w)
                if not any(c.isdigit() for c in w):
                    continue
                if all(c in "0123456789abcdef" for c in w) or all(c in "0123456789ABCDEF" for c in w):
                    limit = 3.0
                elif all(c.isdigit() or c.islower() for c in w):
                    limit = 3.5
                elif up and low:
                    limit = 3.7
                else:
                    continue
                if window_entropy(w) >= limit - 1e-12:
                    covered |= set(range(i, i + 20))
            assert covered == {x for a, b in secret_scan.dense_windows(s) for x in range(a, b)}


def test_allow_list_silences_the_harmless():
    for s in ("internationalizationsupport", "2024-01-02-2024-01-03-2024", "550e8400-e29b-41d4-a716-446655440000",
              "path/to/some/module/file", "abc1abc1abc1abc1abc1abc1", "EXAMPLEKEY1234abcdEFGH5678"):
        assert secret_scan.entropy_spans(f"see {s} here", []) == []
    assert secret_scan.entropy_spans("key wJalrXUtnFEMI7K7MDENGbPxRfiCY9 end", [])


def test_upper_case_keys_and_keys_beside_placeholders_are_found():
    rng = random.Random(21)
    upper = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(32))
    mixed = "".join(rng.choice("GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    assert secret_scan.entropy_spans(f"seed {upper} end", []) == [(5, 3, 37)]
    for before in ("/example/", "dummy_key=", "example-", "changeme"):
        (a, _, b), = secret_scan.entropy_spans(f"see {before}{mixed}/example", [])
        assert a <= 4 + len(before) and b >= 4 + len(before) + len(mixed)
    for s in ("example/path/to/some/module/file", "example-2024-01-02-2024-01-03-2024", "xxxxxxxxxxxxxxxxxxxxxxxx1",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "THIS_IS_A_LONG_CONSTANT_NAME_2"):
        assert secret_scan.entropy_spans(f"see {s} here", []) == []


# --- 8: substring dedup

def test_units_tile_the_text():
    for t in ("", "  a b.\nc", "naïve 漢字 ok. " * 40, PASSAGE, "\n\n x \n"):
        h, n, a, b = substring_dedup.units(t.encode())
        assert n.sum() == len(words(t))
        if len(a):
            assert (a[1:] == b[:-1]).all() and b[-1] == len(t) and words(t[a[0]:]) == words(t)


def test_repeated_passages_are_cut_and_the_first_stays(spark, docs, rows):
    found = substring_dedup.repeated_passages(docs).collect()
    cut = defaultdict(int)
    text = {i: t for i, t, *_ in rows}
    for r in found:
        if r.doc >= 0:
            cut[r.doc] += r.n_words
            assert len(words(text[r.doc][r.start:r.end])) == r.n_words
    assert {18, 19} <= set(cut) and cut[19] >= 30 and not {1, 2, 3, 4, 5, 6, 8, 16, 20} & set(cut)
    out = substring_dedup.remove_repeats(docs)
    assert out.schema.names == SCHEMA.names and out.count() == len(rows)
    left = {r.doc_id: r.text for r in out.where("doc_id in (4, 18)").collect()}
    assert left[4] == "one" and left[18].startswith("other words first.") and len(words(left[18])) < 40


def test_repeated_units_against_brute_force(spark, given):
    """All passages of 30 or more words made of units seen earlier, by a plain scan in rank order."""
    seen, want = set(), Counter()
    for i, t, _ in sorted(given):
        h, n, a, b = substring_dedup.units((t or "").encode())
        run = []
        flags = []
        for x in zip(h.tolist(), n.tolist(), strict=True):
            flags.append(x in seen)
            seen.add(x)
        for k, f in enumerate([*flags, False]):
            if f:
                run.append(k)
            elif run:
                if n[run].sum() >= 30:
                    want[i, int(a[run[0]]), int(b[run[-1]]), int(n[run].sum()), len(run)] += 1
                run = []
    assert Counter(map(tuple, QUERIES["op8_substring_dedup"](spark, SF).collect())) == want


# --- 5 and 9: classifiers

@pytest.mark.parametrize("name,column,folds,out,limit,least", [
    ("op5_quality", "quality", 3, 1, 0.5, 0.95), ("op9_toxicity", "toxic", 4, 2, 0.3, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, column, folds, out, limit, least):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (fold(i, folds) == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    labels = [(r.doc_id, r[column]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= least * len(held)
    again = {r.doc_id: r.score for r in QUERIES[name](spark, sf).collect()}
    assert again == {i: r.score for i, r in got.items()}


@pytest.mark.parametrize("fn", [quality.quality, toxicity.toxicity])
def test_classifiers_on_awkward_rows(spark, docs, rows, fn):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(9, None, None), (None, 1, 1), (999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = fn(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    none = fn(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95 and (0, 1) in [tuple(sorted(p)) for p in model.pairs]


# --- 10: embeddings

def cosine_brute(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(
        c is not None and np.isfinite(c) for c in v) and np.linalg.norm(np.array(v, float)) > 0]
    links, root = Counter(), {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, v), (j, w) in itertools.combinations(good, 2):
        if i != j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
            links[i] += 1
            links[j] += 1
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows if i is not None}


@pytest.mark.parametrize("chunk", [1024, 8])
def test_embedding_dedup(spark, chunk):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((6, 32))
    rows = [(i, (centre[i % 6] + 0.12 * rng.standard_normal(32)).tolist()) for i in range(90)]
    rows += [(100 + i, rng.standard_normal(32).tolist()) for i in range(60)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(300, [2.0 * c for c in rows[0][1]]), (301, [-c for c in rows[0][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 32), (403, [None] * 32), (404, [float("nan")] * 32),
             (405, [float("inf")] + [1.0] * 31), (406, [1.0, 2.0]), (407, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"label": F.lit(None).cast("int"), "cls": F.lit("clash"), "v": F.lit("clash")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df, recall=0.9999, chunk=chunk).collect()}
    assert got == cosine_brute(rows)


def test_embedding_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    o, q = rng.standard_normal((2, 48))
    o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
    est, inside = [], 0
    for seed in range(400):
        r = embedding_dedup.rotations(48, 1, seed)
        assert np.allclose(r @ r.T, np.eye(48))
        x = np.where(r @ o >= 0, 1, -1) / np.sqrt(48)
        f = x @ (r @ o)
        est.append(x @ (r @ q) / f)
        inside += abs(est[-1] - o @ q) <= embedding_dedup.CONFIDENCE * np.sqrt((1 - f * f) / (f * f * 47))
    assert abs(np.mean(est) - o @ q) < 0.02 and inside == 400


def test_embedding_query_against_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op10_embedding_dedup"](spark, SF).collect()}
    assert got == cosine_brute(rows)


# --- all: empty tables; and the pipeline

def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (ngram_join.ngram_components(none), bpe.round_trip(none, VOCABULARY), mixing.mix(none),
                mixing.mixed_documents(none), line_dedup.line_dedup_report(none), line_dedup.drop_lines(none),
                quality.quality(none, labels), secret_scan.secret_scan(none), exact_dedup.exact_dedup(none),
                substring_dedup.repeated_passages(none), substring_dedup.remove_repeats(none),
                toxicity.toxicity(none, labels), embedding_dedup.embedding_dedup(vectors),
                ngram_join.keep_one_per_component(none)):
        assert out.collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in after}
            good, bad = ([x for x, y in labels.items() if y == k] for k in (1, 0))
            assert sum(x in kept for x in good) >= 0.97 * len(good) and sum(x in kept for x in bad) <= 0.1 * len(bad)
        elif name == "line_dedup":
            want = {i: (d, h) for i, n, d, h in line_report(before)}
            assert all(want[r.doc_id][1] == sha(r.text) for r in after)
            assert {r.doc_id for r in after} == {i for i, t in before if want[i][0] == 0 or want[i][1] != sha("")}
        elif name == "ngram_join":
            want = jaccard_components(before, percent=80, width=5)
            assert sorted(r.doc_id for r in after) == sorted(i for i, c in want.items() if i == c)
        elif name == "mix":
            assert {r.doc_id for r in after} <= {i for i, _ in before}
            assert max(Counter(r.doc_id for r in after).values()) <= 3
        else:
            assert Counter(r.doc_id for r in after) == Counter(i for i, _ in before)
            assert all(r.round_trip_ok for r in after)


def test_pipeline_keeps_one_of_a_large_group_of_copies(spark):
    """Twelve copies of a clean text, of a one-line text and twelve near copies, with a common line in all: one of each stays."""
    import corpus_pipeline
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    common, clean, single, near = "all rights reserved", [line(9) for _ in range(8)], line(12), [line(9) for _ in range(20)]
    rows = [(i, "\n\n".join(clean)) for i in range(12)] + [(i, single) for i in range(20, 32)]
    rows += [(i, "\n".join([*near[:10], line(4), *near[10:]])) for i in range(40, 52)]
    rows += [(i, "\n".join([line(9), common, line(9)])) for i in range(60, 75)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], SCHEMA[:5])
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, SF)
    text = {r.doc_id: r.text for r in lines.collect()}
    assert text[0].split() == " ".join(clean).split() and text[20] == single and text[40] == rows[24][1]
    assert not any(text[i].split() for i in range(1, 12) if i in text) and not set(range(21, 32)) & set(text)
    assert all(len(text[i].split("\n")) == 1 for i in range(41, 52)) and not any(common in t for t in text.values())
    kept = stages["ngram_join"](spark, lines, SF).where(F.trim("text").rlike("[a-j]")).collect()
    assert {0, 20, 40} <= {r.doc_id for r in kept} and not {*range(1, 12), *range(21, 32)} & {r.doc_id for r in kept}
