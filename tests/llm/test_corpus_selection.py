"""Sharding, collocations and importance resampling on awkward rows and a given table, against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures_llm import SCHEMA, ascii_lower, awkward_texts, frame
from pyspark.sql import functions as F

from riskloom.llm import collocations, ordering, resampling, sharding
from riskloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def given(spark, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*columns).collect()]


# --- 11: sharding

def draws(key, weights):
    out = []
    for i, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        out.append(-math.log(u) / w if w else math.inf)
    return out


def shard_brute(rows, weights=(1.0,) * 16, new=1.0):
    """Counter of (doc_id, size, crc, shard, grown shard)."""
    out = Counter()
    for i, t, *_ in rows:
        body = (t or "").encode()
        key = str(i) if i is not None else "text:" + hashlib.md5(body).hexdigest()
        d = draws(key, [*weights, new])
        out[i, len(body) + 1, zlib.crc32(body), d.index(min(d[:-1])), d.index(min(d))] += 1
    return out


def check_shards(got, rows, **options):
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == shard_brute(rows, **options)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, (r.doc_id is None, r.doc_id or 0)))
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own)))
        assert [i for _, i in own] == sorted(i for _, i in own)


def test_sharding(spark, docs, rows):
    check_shards(sharding.sharding(docs).collect(), rows)
    got = QUERIES["op11_sharding"](spark, SF).collect()
    check_shards(got, given(spark, "doc_id", "text"))
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 16) for r in got)


def test_sharding_weights(spark):
    rows = [(i, "t", "a") for i in range(4000)]
    got = sharding.sharding(frame(spark, rows), [4.0, 0.0, 1.0], 5.0).collect()
    check_shards(got, rows, weights=(4.0, 0.0, 1.0), new=5.0)
    share = Counter(r.shard for r in got)
    assert share[1] == 0 and abs(share[0] - 3200) < 150 and abs(sum(r.grown_shard == 3 for r in got) - 2000) < 150
    with pytest.raises(ValueError):
        sharding.assigned(frame(spark, rows[:1]), [0.0, 0.0])


def test_moved_rows_go_where_weight_grows(spark):
    docs = frame(spark, [(i, "t", "a") for i in range(2000)])
    up = sharding.moved(docs, [1.0, 1.0, 1.0], [1.0, 2.0, 1.0]).collect()
    assert up and {r.to_shard for r in up} == {1}
    gone = sharding.moved(docs, [1.0] * 5, [1.0] * 4).collect()
    assert gone and {r.from_shard for r in gone} == {4} and {r.to_shard for r in gone} == {0, 1, 2, 3}


def test_sharding_hot_text_without_ids(spark):
    rows = [(None if i % 3 else i, "same" if i % 3 else f"own {i}", "a") for i in range(900)]
    check_shards(sharding.sharding(frame(spark, rows).repartition(7)).collect(), rows)


def test_write_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"), [1.0, 3.0])
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = Counter((i, t, s) for (i, t, s) in rows)
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == want
    shards = {r.doc_id: r.shard for r in back.where("doc_id IS NOT NULL").collect()}
    assert all(shards[i] == draws(str(i), [1.0, 3.0]).index(min(draws(str(i), [1.0, 3.0]))) for i in shards)
    assert {r.score for r in back.collect()} == {"clash"}


def test_sharding_empty(spark):
    assert sharding.sharding(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("partitions", [1, 5])
def test_numbered_over_partitions(spark, partitions):
    df = spark.createDataFrame([(i * 37 % 101, i % 2) for i in range(505)], "x long, y int").repartition(partitions)
    out = ordering.numbered(df, [F.desc("x"), "y"], "at").orderBy("at").collect()
    assert [r.at for r in out] == list(range(505)) and [(-r.x, r.y) for r in out] == sorted((-r.x, r.y) for r in out)


# --- 12: collocations

def collocation_brute(rows, min_count, inside=50, top=2000):
    """Rows of the result for rows (lang, text)."""
    import re
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i:i + k])] += 1
    found = defaultdict(list)
    for (lang, p), a in count.items():
        if len(p) < 2 or a < min_count:
            continue
        if len(p) == 2 and any(100 * f >= inside * a for (g, q), f in count.items()
                               if g == lang and len(q) == 3 and f >= min_count and p in (q[:2], q[1:])):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = count[lang, p[:k]], count[lang, p[k:]]
            cuts.append((10 ** 6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def in_languages(spark, rows):
    data = [(i, t, ["en", None, "und", "fr"][n % 4], None, 0, *["clash"] * 9) for n, (i, t, *_) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA), [(r[2], r[1]) for r in data]


def test_collocations(spark, rows):
    # 50,000 repeats of two words in one text, copies, pieces that end in and after a repeated phrase
    more = [(900 + i, t, "x") for i, t in enumerate(
        ["the quick brown fox, the quick brown fox jumps", "a quick brown fox jumps over; lazy dogs", "x x x x x x", "", None,
         "over the lazy dogs. over the lazy dogs! Over THE lazy", "lazy\tdogs \t over the", "Ünïcode Wörter hier. ünïcode Wörter hier"] * 5)]
    df, plain = in_languages(spark, rows + more)
    for count, inside, top in ((2, 50, 2000), (3, 100, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, count, inside, top).collect())
        assert got == collocation_brute(plain, count, inside, top) and got


def test_collocations_of_the_table(spark):
    got = sorted(tuple(r) for r in QUERIES["op12_collocations"](spark, SF).collect())
    assert got == collocation_brute(given(spark, "lang", "text"), 10) and len(got) > 100


def test_unary_paths(spark):
    """A passage that always comes whole is one path; where its copies part, paths end."""
    passage = [f"w{i}" for i in range(40)]
    text = " ".join(passage)
    rows = [(i, f"{text}. {' '.join(passage[:20])} other{i % 2} end", "a") for i in range(6)]
    _, edges, _ = graph = collocations.word_graph(frame(spark, rows), 3)
    around = collocations.ways(edges, graph[0].where("n_words = 2"))
    got = sorted((tuple(r["words"]), r["weight"]) for r in collocations.paths(edges, around).collect())
    want = [(passage[:20], 12), (passage[18:], 6)] + [([*passage[18:20], f"other{x}", "end"], 3) for x in range(2)]
    assert got == sorted((tuple(w), n) for w, n in want)


def test_flows_count_every_gram(spark):
    rows = [(1, "a b a b c, a b", "x"), (2, "b", "x"), (3, "a b a b c", "x")]
    flow = {(r.gram): r.weight for r in collocations.flows(collocations.grams(frame(spark, rows))).collect()}
    assert flow == {"a": 5, "b": 6, "c": 2, "a b": 5, "b a": 2, "b c": 2}


def test_scores_beyond_64_bits(spark):
    a, left, right = 6_000_000_000_001, 7_000_000_000_003, 8_500_000_000_007
    found = spark.createDataFrame([("en", "p q r", a, "p", "r", left, right), ("en", "p r", a, "p", "r", None, None)],
                                  "lang string, phrase string, a long, head string, tail string, head2 long, tail2 long")
    counts = spark.createDataFrame([("en", "p", right, 1), ("en", "r", left, 1)], "lang string, gram string, weight long, n_words int")
    got = {r.phrase: (r.l, r.r, r.score) for r in collocations.with_scores(found, counts).collect()}
    assert got == {"p q r": (right, right, 10 ** 6 * a * a // (right * right)), "p r": (right, left, 10 ** 6 * a * a // (right * left))}


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


# --- 13: importance resampling

def resampling_brute(rows, target, min_words=20, percent=25, seed=7):
    """doc_id, n_features, weight, score, rank of each row."""
    def tokens(text):
        import re
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))

    def buckets(w):
        return [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(buckets(tokens(text)))
    for text in target:
        t.update(buckets(tokens(text)))
    n, m = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in rows:
        w = tokens(text)
        b = buckets(w)
        gain = [math.floor(1000 * math.log((t[x] + 1) * (n + 10000) / ((s[x] + 1) * (m + 10000)))) for x in b]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    chosen = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = defaultdict(list)
    for rank, r in enumerate(chosen[:percent * len(chosen) // 100], 1):
        ranks[tuple(r)].append(rank)
    return Counter((*r[:4], ranks[tuple(r)].pop() if ranks[tuple(r)] else None) for r in out)


def test_resampling(spark, docs, rows):
    target = [PHRASE for PHRASE in ("alpha1 alpha2 alpha3", "", None, "Shared LINE own")]
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    for words, percent in ((20, 25), (1, 60), (0, 100)):
        got = Counter(tuple(r) for r in resampling.resampling(docs, wanted, words, percent).collect())
        assert got == resampling_brute(rows, target, words, percent)


def test_resampling_of_the_table(spark):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in QUERIES["op13_resampling"](spark, SF).collect())
    assert got == resampling_brute(given(spark, "doc_id", "text"), target)


def test_resampling_copies_at_the_cutoff(spark):
    """A third of all rows are one row: exactly the wanted number is drawn, reruns agree."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(0 if i % 3 else i, text, "a") for i in range(300)] + [(None, text, "a")] * 40
    wanted = spark.createDataFrame([("w1 w2",)], "text string")
    df = frame(spark, rows)
    got = Counter(tuple(r) for r in resampling.resampling(df, wanted, percent=40).collect())
    assert got == resampling_brute(rows, ["w1 w2"], percent=40)
    assert got == Counter(tuple(r) for r in resampling.resampling(df.repartition(9), wanted, percent=40).collect())
    assert sorted(r[4] for r in got.elements() if r[4]) == list(range(1, 137))


def test_resampled_documents_lean_to_the_target(spark):
    like, other = (" ".join(f"{x}{i % 11}" for i in range(40)) for x in ("math", "noise"))
    rows = [(i, like if i % 10 == 0 else other, "a") for i in range(1000)]
    wanted = spark.createDataFrame([(like,)] * 5, "text string")
    out = resampling.resampled_documents(frame(spark, rows), wanted, percent=10).collect()
    assert len(out) == 100 and sum(r.text == like for r in out) >= 80 and {r.score for r in out} == {"clash"}


def test_resampling_empty(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resampling(none, docs).collect() == []
    assert resampling.resampling(docs, none).count() == docs.count()


@pytest.mark.parametrize("wanted", [1, 2, 17, 999, 1000])
def test_least_with(wanted):
    values = sorted((x * 7919) % 5003 - 2500 for x in range(1000))
    jobs = []

    def counts(places):
        jobs.append(len(places))
        return [sum(v <= p for v in values) for p in places]
    assert resampling.least_with(counts, values[0], values[-1], wanted) == values[wanted - 1]
    assert len(jobs) <= 6 and max(jobs) <= resampling.PROBES + 1


# --- further cases of earlier operators

def test_mix_of_rows_without_ids_does_not_depend_on_partitions(spark):
    from riskloom.llm import mixing
    rows = [(None if i % 2 else i, " ".join(f"w{i}x{j}" for j in range(3 + i % 40)), "s" if i % 3 else "t") for i in range(400)]
    df = frame(spark, rows)
    one, other = (Counter(r.text for r in mixing.mixed_documents(x).collect()) for x in (df, df.repartition(9)))
    assert one == other and one


def test_remove_repeats_keeps_a_column_of_its_own_name(spark):
    from riskloom.llm import substring_dedup
    passage = " ".join(f"same{i}" for i in range(60)) + "."
    df = frame(spark, [(i, f"own{i} start.\n{passage}\nend {i}.", "a") for i in range(4)])
    out = substring_dedup.remove_repeats(df).collect()
    assert {r.doc for r in out} == {"clash"} and sum("same7" in r.text for r in out) == 1


def test_toxicity_gathers_a_bounded_number_of_features(spark):
    from riskloom.llm import toxicity
    docs = frame(spark, [(i, f"{'vile' if i % 2 else 'kind'} words {i} " * 20, "a") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    whole = toxicity.learn(docs, labels, F.lit(True))
    part = toxicity.learn(docs, labels, F.lit(True), max_slots=2000)
    none = toxicity.learn(docs, labels, F.lit(True), max_slots=0)
    assert len(whole[0]) and len(part[0]) and not len(none[0])
