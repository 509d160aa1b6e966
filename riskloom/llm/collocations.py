"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words; everything is for each language.

1. *Edges.*  Every position of a piece yields its longest gram: three words, an edge from the node of its
   first two words to the node of its last two.  Where the piece ends before, the gram is shorter: these
   are the piece-end corrections.  Equal grams are counted, first inside each task.
2. *Flow.*  A node's count is the weight of its outgoing edges plus that of the pieces that end at it; a
   word's count is that of all grams that start with it.  No shorter gram is ever counted from text.
3. *Unary paths.*  Of the edges that are candidates, those that meet at a node through which all its
   flow passes (one way in and one way out, of the node's own count) are compacted into paths by
   pointer doubling.  All words of a path have its weight between them, so the counts of its inner nodes
   are read off the path; only its two ends are looked up.  There is no cycle: every piece
   enters and leaves.
4. *Scores.*  For each cut of a candidate, a * a / (l * r), in exact decimals (38 digits, so counts below
   10^16); the lowest cut counts.  A pair of words that lies in an edge of at least ``inside`` percent
   of its count is dropped; inner nodes of paths always are.
5. *Best of each language.*  First inside salted parts of a language, then among their winners.

Rows: a null text is empty; empty pieces hold no words.  A null language is ``und``.  Repeated rows count
each time.  Ties in score and count go to the smaller phrase in UTF-8 byte order.  Other columns are
not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import shuffled, text_or_empty, written
from riskloom.llm.exact_dedup import ascii_lower

PIECE_END = r"[.,;:!?\x0A-\x0D]"
LONGEST = 3
SALTS = 32


def words_in(gram: Column) -> Column:
    return F.length(gram) - F.length(F.translate(gram, " ", "")) + 1


def first(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def last(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", -n)


def grams(docs: DataFrame) -> DataFrame:
    """lang, gram, weight: the longest gram at each position (piece ends: shorter ones), counted."""
    pieces = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                         F.explode(F.split(F.translate(ascii_lower(text_or_empty()), "\t", " "), PIECE_END)).alias("piece"))
    words = pieces.where("piece <> ''").select("lang", F.filter(F.split("piece", " "), lambda w: w != "").alias("words"))
    at = words.select("lang", "words", F.posexplode("words").alias("i", "word"))
    gram = F.concat_ws(" ", "word", *[F.get("words", F.col("i") + k) for k in range(1, LONGEST)])  # nulls beyond the end are left out
    return at.select("lang", gram.alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("weight"))


def flows(edges: DataFrame, min_count: int = 1) -> DataFrame:
    """lang, gram, n_words, weight of nodes (two words) and words, of at least ``min_count``, from the flow along the edges.

    A node's flow is summed from the edges, a word's from the nodes that start with it; pieces that end add their own.
    """
    nodes = edges.select("lang", first(F.col("gram"), 2).alias("gram"), "weight").groupBy("lang", "gram").agg(
        F.sum("weight").alias("weight"))
    word, two = first(F.col("gram"), 1), F.instr("gram", " ") > 0
    both = F.when(two & (F.col("weight") >= min_count), F.array(word, F.col("gram"))).otherwise(F.array(word))
    return nodes.select("lang", F.explode(both).alias("gram"), "weight").groupBy("lang", "gram").agg(
        F.sum("weight").alias("weight")).where(F.col("weight") >= min_count).withColumn("n_words", words_in(F.col("gram")))


def ways(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """lang, node, weight, most, enters for each of ``nodes``: the heaviest edge at it, and the edge by which all its
    flow enters if it is unary (all of it also leaves by one edge), else null."""
    ends = edges.select("lang", "gram", "weight", F.explode(F.array(
        F.struct(first(F.col("gram"), 2).alias("node"), F.lit(False).alias("enters")),
        F.struct(last(F.col("gram"), 2).alias("node"), F.lit(True).alias("enters")))).alias("at"))
    around = ends.groupBy("lang", F.col("at.node").alias("node")).agg(
        F.max(F.when(~F.col("at.enters"), F.col("weight"))).alias("leaving"),
        F.max(F.when(F.col("at.enters"), F.struct("weight", "gram"))).alias("entering"))
    joined = nodes.select("lang", F.col("gram").alias("node"), "weight").join(shuffled(around), ["lang", "node"], "left")
    unary = (F.col("leaving") == F.col("weight")) & (F.col("entering.weight") == F.col("weight"))
    return joined.select("lang", "node", "weight", F.coalesce(F.greatest("leaving", "entering.weight"), F.lit(0)).alias("most"),
                         F.when(unary, F.col("entering.gram")).alias("enters"))


def paths(edges: DataFrame, around: DataFrame) -> DataFrame:
    """lang, words (array), weight: the compacted unary paths of ``edges``; an edge between other nodes is a path of its own.

    A path is no longer than the pieces it stands in.
    """
    unary = around.where("enters IS NOT NULL").select("lang", F.col("node").alias("from"), "enters")
    at = edges.select("lang", "gram", "weight", first(F.col("gram"), 2).alias("from")).join(
        shuffled(unary), ["lang", "from"], "left")
    at = written(at.select("lang", "gram", "weight", F.coalesce("enters", "gram").alias("up"),
                           F.col("enters").isNotNull().cast("long").alias("steps")), "path-steps")
    while not at.where("steps > 0").isEmpty():
        above = at.select("lang", F.col("gram").alias("up"), F.col("up").alias("higher"), F.col("steps").alias("more"))
        doubled = written(at.join(shuffled(above), ["lang", "up"]).select(
            "lang", "gram", "weight", F.col("higher").alias("up"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("more") > 0).alias("moved")), "path-steps")
        at = doubled.drop("moved")
        if doubled.where("moved").isEmpty():
            break
    tail = F.sort_array(F.collect_list(F.struct("steps", last(F.col("gram"), 1).alias("word"))))
    return at.groupBy("lang", "up").agg(F.first("weight").alias("weight"), tail.alias("tail")).select(
        "lang", F.concat(F.split(first(F.col("up"), 2), " "), F.transform("tail", lambda t: t["word"])).alias("words"), "weight")


def candidates(graph: DataFrame, around: DataFrame, inside: int) -> DataFrame:
    """lang, phrase, a, head, tail, head2, tail2: what stays, with first and last word, and the counts of the first and last two words."""
    node = around.select("lang", F.col("node"), "weight")
    n = F.size("words")
    ends = graph.withColumns({"__first": F.concat_ws(" ", F.slice("words", 1, 2)), "__last": F.concat_ws(" ", F.slice("words", -2, 2))})
    ends = ends.join(shuffled(node.select("lang", F.col("node").alias("__first"), F.col("weight").alias("flow1"))), ["lang", "__first"])
    ends = ends.join(shuffled(node.select("lang", F.col("node").alias("__last"), F.col("weight").alias("flow2"))), ["lang", "__last"])
    three = ends.select("lang", "words", "weight", "flow1", "flow2", n.alias("n"), F.posexplode(F.slice("words", 3, n)).alias("i", "tail"))
    at = F.col("i") + 1
    three = three.select(
        "lang", F.concat_ws(" ", F.slice("words", at, F.lit(3))).alias("phrase"), F.col("weight").alias("a"),
        F.element_at("words", at).alias("head"), "tail",
        F.when(F.col("i") == 0, F.col("flow1")).otherwise(F.col("weight")).alias("head2"),
        F.when(F.col("i") == F.col("n") - 3, F.col("flow2")).otherwise(F.col("weight")).alias("tail2"))
    none = F.lit(None).cast("long")
    two = around.where(100 * F.col("most") < inside * F.col("weight")).select(
        "lang", F.col("node").alias("phrase"), F.col("weight").alias("a"), first(F.col("node"), 1).alias("head"),
        last(F.col("node"), 1).alias("tail"), none.alias("head2"), none.alias("tail2"))
    return three.unionByName(two)


def with_scores(found: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score by the lowest-scoring cut (ties: the first)."""
    word = counts.where("n_words = 1").select("lang", "gram", "weight")
    rows = found.join(shuffled(word.select("lang", F.col("gram").alias("head"), F.col("weight").alias("head1"))), ["lang", "head"])
    rows = rows.join(shuffled(word.select("lang", F.col("gram").alias("tail"), F.col("weight").alias("tail1"))), ["lang", "tail"])
    rows = rows.withColumn("r1", F.coalesce("tail2", "tail1"))
    exact = ("cast(1000000 as decimal(7,0)) * cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(31,0))"
             " div (cast({0} as decimal(18,0)) * cast({1} as decimal(18,0)))")
    rows = rows.withColumns({"s1": F.expr(exact.format("head1", "r1")), "s2": F.expr(exact.format("head2", "tail1"))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    return rows.select("lang", "phrase", "a", F.when(second, F.col("head2")).otherwise(F.col("head1")).alias("l"),
                       F.when(second, F.col("tail1")).otherwise(F.col("r1")).alias("r"),
                       F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))


def best(rows: DataFrame, top: int) -> DataFrame:
    """``rows`` with ``rank``: the first ``top`` of each language by score, a (both falling) and phrase."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(
        F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top).drop("__salt")


def word_graph(docs: DataFrame, min_count: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts of nodes and words, edges, number of words of each language); counts and edges of at least ``min_count``."""
    every = written(grams(docs), "grams")
    counts = written(flows(every, min_count), "gram-flows")
    edges = written(every.where((F.col("weight") >= min_count) & (words_in(F.col("gram")) == LONGEST)), "edges")
    total = every.groupBy("lang").agg(F.sum("weight").alias("n"))  # one gram starts at every word
    return counts, edges, written(total, "language-words")


def collocations(docs: DataFrame, min_count: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words of each language."""
    counts, edges, total = word_graph(docs, min_count)
    around = written(ways(edges, counts.where("n_words = 2")), "ways")
    graph = written(paths(edges, around), "paths")
    ranked = best(with_scores(candidates(graph, around, inside), counts), top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
longer AS (SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, f, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM f WHERE k = 3 AND f >= 10) GROUP BY lang, phrase),
c AS (SELECT f.lang, f.phrase, f.ws, f.f AS a, f.k FROM f LEFT JOIN longer USING (lang, phrase)
      WHERE f.f >= 10 AND (f.k = 3 OR f.k = 2 AND 100 * coalesce(most, 0) < 50 * f.f)),
cut AS (SELECT c.*, t.i, array_to_string(ws[:t.i], ' ') AS head, array_to_string(ws[t.i + 1:], ' ') AS tail
        FROM c, (VALUES (1), (2)) t(i) WHERE t.i < c.k),
s AS (SELECT cut.lang, cut.phrase, cut.a, x.f AS l, y.f AS r,
             CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score, i
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.head JOIN f y ON y.lang = cut.lang AND y.phrase = cut.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
