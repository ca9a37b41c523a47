"""Spelling variants by a trie of letter counts.

A word's letters fall into groups, and how often each group occurs is a vector of small numbers. One inserted, deleted
or replaced letter adds at most one to one group and takes at most one from another. So the distinct vectors are
arranged in a trie, a few groups to a level, and every vector goes down it with a budget of one surplus and one
deficit: level by level the partial vectors that no node of the trie has are dropped. Only the words of the leaves
that are reached are compared.

As the relation is symmetric, a vector looks for its surplus first; the other of the two finds the rest. In a pair of
leaves only words that share their first or their last half are put side by side, which every pair with one edit does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.registry import query, table
from chronopanel.llm.text import ascii_lower, id_and_text
from chronopanel.session import materialize

# Groups of letters and how many of them make a level of the trie. A letter's group is its code point modulo the
# number of groups; the last group also takes all that is no letter of the list.
GROUPS, LEVEL = 24, 6
# Counts from 35 on share the last digit: near words differ there by one at most before, and by one or nothing after.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0xC0, 0x100))]
# Nodes of a level (up to 24 characters each) that may be broadcast.
MAX_BROADCAST_NODES = 200_000

RUN = r"[A-Za-zÀ-ÿ]+"


def vector(word: Column) -> Column:
    """A digit per group: how many of the word's letters are in it."""
    length = F.char_length(word)
    counts = []
    for g in range(GROUPS - 1):
        mine = "".join(x for x in LETTERS if ord(x) % GROUPS == g)
        counts.append(length - F.char_length(F.translate(word, mine, "")))
    counts.append(length - sum(counts[1:], counts[0]))
    return F.concat(*[F.substring(F.lit(DIGITS), F.least(n, F.lit(len(DIGITS) - 1)) + 1, F.lit(1)) for n in counts])


def _steps(v: Column, s: Column, level: int) -> Column:
    """What a partial vector may turn into at a level: array of (v, s). s: 0 nothing spent, 1 the surplus, 2 both."""
    places = range(level * LEVEL, (level + 1) * LEVEL)
    digit = {i: F.substring(v, i + 1, 1) for i in places}
    put = lambda x, i, d: F.overlay(x, d, i + 1, 1)
    more = {i: put(v, i, F.translate(digit[i], DIGITS[:-1], DIGITS[1:])) for i in places}
    less = {i: F.translate(digit[i], DIGITS[1:], DIGITS[:-1]) for i in places}
    to = lambda x, spent: F.struct(x.alias("v"), F.lit(spent).alias("s"))
    fresh, half = s == 0, s == 1
    out = [F.struct(v.alias("v"), s.alias("s"))]
    out += [F.when(fresh, to(more[i], 1)) for i in places]
    out += [F.when(fresh & (digit[j] != "0"), to(put(more[i], j, less[j]), 2)) for i in places for j in places if i < j]
    out += [F.when(half & (digit[j] != "0"), to(put(v, j, less[j]), 2)) for j in places]
    return F.array_compact(F.array(*out))


def leaf_pairs(vectors: DataFrame) -> DataFrame:
    """(u, v, s) of the distinct ``vectors`` (u): leaves v that u reaches; s as in `_steps`. Each two leaves once or in both directions."""
    frontier = vectors.select("u", F.col("u").alias("v"), F.lit(0).alias("s"))
    for level in range(GROUPS // LEVEL):
        depth = (level + 1) * LEVEL
        nodes = vectors.select(F.substring("u", 1, depth).alias("node")).distinct()
        if depth == GROUPS:
            nodes = vectors.select(F.col("u").alias("node"))
        nodes = materialize(nodes)
        small = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_NODES else nodes
        stepped = frontier.select("u", F.explode(_steps(F.col("v"), F.col("s"), level)).alias("x")).select("u", "x.v", "x.s")
        frontier = materialize(stepped.join(small, F.substring("v", 1, depth) == F.col("node"), "left_semi"))
    return frontier


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), each pair of the distinct ``words`` (word) once in either direction: those with exactly one edit between them."""
    words = materialize(words.select("word", vector(F.col("word")).alias("vec")))
    pairs = materialize(leaf_pairs(words.select(F.col("vec").alias("u")).distinct()))
    full = F.col("u").contains(DIGITS[-1]) | F.col("v").contains(DIGITS[-1])

    def side(own: str, length: Column, out: str) -> DataFrame:
        """The words of a leaf of the pair, by each half that a near word may share; ``length``: of the shorter of the two."""
        lengths = F.when(full, F.array(F.char_length("word"), F.char_length("word") - 1)).otherwise(F.array(length))
        placed = pairs.join(words, F.col(own) == F.col("vec")).withColumn("m", F.explode(lengths))
        half = F.floor(F.col("m") / 2).cast("int")
        ends = F.array(F.struct(F.lit(0).alias("end"), F.left("word", half).alias("half")), F.struct(F.lit(1).alias("end"), F.right("word", half).alias("half")))
        placed = placed.select("u", "v", "m", "word", F.explode(ends).alias("e"))
        return placed.select(F.xxhash64("u", "v", "m", "e.end", "e.half").alias("key"), (F.col("u") == F.col("v")).alias(f"one_{out}"), F.col("word").alias(out))

    n = F.char_length("word")
    left = side("u", n, "a")
    right = side("v", F.when(F.col("s") == 1, n - 1).otherwise(n), "b")
    once = ~F.col("one_a") | (F.col("a") < F.col("b"))
    joined = left.join(right, "key").filter(once & (F.levenshtein("a", "b", 1) == 1))
    # Both ends may be shared, and two leaves may reach each other.
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spelling_variants(words: DataFrame, word_col: str = "word", n_col: str = "n", factor: int = 5) -> DataFrame:
    """A row per distinct word: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. ``n_near`` is the number
    of near words, ``form`` the near word of largest n (of equals the first in code-point order) if its n is ``factor``
    times the word's n or more, else null, ``form_n`` its n, and ``root`` the end of the chain of forms, the word
    itself where it has none.

    Rows of one word are added up, null counts as 0. Null words are left out; the empty word is near to every word of one code
    point. An empty table gives an empty result. Other columns are not read.
    """
    known = words.select(F.col(f"`{word_col}`").alias("word"), F.coalesce(F.col(f"`{n_col}`"), F.lit(0)).cast("bigint").alias("n"))
    known = materialize(known.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")))
    pairs = materialize(near_words(known.select("word")))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    of = known.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = both.join(of, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    # A form has more than its word, so chains end.
    holds = (-F.col("best.m") >= factor * F.col("n")) & (-F.col("best.m") > F.col("n"))
    found = materialize(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.other")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n")))
    # Chains of forms: an n grows by the factor at each step, so they are short; each round halves what is left of them.
    ends = materialize(found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    moved = True
    while moved:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ends, moved = stepped.select("word", "root"), bool(stepped.filter("moved").limit(1).count())
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def run_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 199, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): how often the runs of letters of all texts occur, lower-cased in A-Z, with a slip of the pen planted in some.

    With h the CRC-32 of ``<id>:<run>``, a run whose h ``slip`` divides loses its code point h % length. Words of fewer than
    ``min_chars`` code points or with a lower count than ``min_count`` are left out. A null text has no runs, a null id is "".
    """
    src = id_and_text(docs, id_col, text_col).filter(F.col("__text").isNotNull())
    runs = src.select(F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("id"),
                      F.explode(F.regexp_extract_all(ascii_lower(F.col("__text")), F.lit(RUN), F.lit(0))).alias("run"))
    # A run that is too short stays so.
    runs = runs.filter(F.char_length("run") >= min_chars).withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.char_length("word") >= min_chars) & (F.col("n") >= min_count))


@query(
    "op13_spelling_variants",
    r"""
    WITH crc_table AS (
      SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted),
    hashed AS (
      SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM bytes, crc_table),
    words AS (
      SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT k, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
    near AS (
      SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word),
    best AS (
      SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m
      FROM (SELECT near.word, other, n FROM near JOIN words w ON w.word = near.other) GROUP BY word),
    forms AS (
      SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
      FROM words w LEFT JOIN best USING (word)),
    steps AS (
      WITH RECURSIVE s AS (
        SELECT word, word AS here, 0 AS d FROM forms
        UNION ALL SELECT s.word, f.form, d + 1 FROM s JOIN forms f ON f.word = s.here WHERE f.form IS NOT NULL)
      SELECT word, last(here ORDER BY d) AS root FROM s GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN steps USING (word)
    """,
)
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(run_counts(table(spark, sf_dir, "documents")))
