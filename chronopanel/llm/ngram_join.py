"""Jaccard self-join on word n-grams by a token-group matrix.

Similar documents are put into groups of bounded size, and for each group the union of its members' tokens (shingles)
is stored. A document that is like a member of a group to the threshold must hold so many of the union's tokens; only
groups that meet this bound are opened, and the pairs in them compared on full sets.

What makes this cheap at scale:

* Equal sets are one node. Nodes that cannot have a partner go first, by an exact bound: of the lowest tokens in hash
  order (one and a half times what may differ) a partner shares a certain share, so a node with too few tokens there
  that any other set has is alone.
* Tokens that a node alone has cannot be shared, so at most the rest of the smaller side is: an exact bound of pairs.
* Links to a hub of the same lowest tokens, the node with the least of its own, are confirmed first: of copies of a text with
  changes here and there, that is the text. Groups are then cut from the components these give, and a document is held
  only against groups that hold another component. So n near copies cost about n links.
* A pair shares one of the first tokens of both sets (as many as may differ, and one) in any common order. Here the
  order puts frequent tokens last, so a passage that many documents share proposes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.components import components
from chronopanel.llm.decontamination import row_key
from chronopanel.llm.hashing import SPACED, gram_hashes, in_pieces, mix, word_hashes
from chronopanel.llm.registry import query, table
from chronopanel.session import materialize

SHINGLE_WORDS = 4
# Lowest tokens by which a node is linked to the least node that has them, too.
HUB_TOKENS = 3
# Members and tokens of a group, on average at most.
GROUP_NODES, GROUP_TOKENS = 32, 1 << 16
# Tokens of more nodes than this are frequent; of these the most frequent are put last, as many as are broadcast
# (8 bytes each). Any choice gives the same links, only more or fewer candidates.
FREQUENT, MAX_FREQUENT = 64, 1_000_000
# Row keys that may be broadcast, 16 bytes and a node number each.
MAX_BROADCAST_ROWS = 100_000

_SET = "array<bigint>"


def token_set(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-word shingles in ascending (signed) order; all words as one if they are fewer."""
    if not len(words):
        return np.empty(0, np.int64)
    return np.unique(gram_hashes(words, min(n, len(words))).astype(np.int64))


def may_differ(n: Column, percent: int) -> Column:
    """Tokens of a set of n that a partner may lack."""
    return F.floor(n * (100 - percent) / 100).cast("bigint")


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Per row: id, __k1 and __k2 (`row_key`), n, s1 and s2 (128 bits that stand for the set), low (its lowest tokens)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, ["id", "__k1", "__k2"], "text"):
            size, s1, s2, low = [], [], [], []
            for words in word_hashes(texts, SPACED):
                tokens = token_set(words, n)
                u = tokens.view(np.uint64)
                size.append(len(tokens))
                s1.append(int(np.add.reduce(mix(u)).astype(np.int64)) if len(u) else 0)
                s2.append(int(np.add.reduce(mix(u ^ np.uint64(0x5555555555555555))).astype(np.int64)) if len(u) else 0)
                low.append(tokens[:HUB_TOKENS])
            yield pa.RecordBatch.from_arrays(
                [ids["id"], ids["__k1"], ids["__k2"], pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(low, pa.list_(pa.int64()))],
                names=["id", "__k1", "__k2", "n", "s1", "s2", "low"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), *row_key(id_col, text_col), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return src.mapInArrow(sign, f"id {dict(src.dtypes)['id']}, __k1 bigint, __k2 bigint, n bigint, s1 bigint, s2 bigint, low {_SET}")


def _sets(texts: DataFrame, n: int, percent: int, lowest: bool) -> DataFrame:
    """(id, set) per row of (id, text): all tokens, or (s, set) the lowest of them and s standing for the whole set."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in in_pieces(batches, [] if lowest else ["id"], "text"):
            sets = [token_set(w, n) for w in word_hashes(rows, SPACED)]
            if lowest:
                ids = {"id": pa.array([int(np.add.reduce(mix(t.view(np.uint64))).astype(np.int64)) if len(t) else 0 for t in sets], pa.int64())}
                sets = [t[: lowest_size(len(t), percent)] for t in sets]
            yield pa.RecordBatch.from_arrays([ids["id"], pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return texts.mapInArrow(cut, f"id {'bigint' if lowest else dict(texts.dtypes)['id']}, set {_SET}")


def lowest_size(n: int, percent: int) -> int:
    """How many of a set's lowest tokens are looked at: what may differ, half of that again, and one."""
    may = n * (100 - percent) // 100
    return may + may // 2 + 1 if n else 0


def _possible(docs: DataFrame, signed: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """(s1, lone): of sets with lowest tokens that no other set has, the number of these.

    The k-th lowest of the tokens that two sets share is among the lowest L(X) of either set X if k + may_differ(X) <= L(X).
    So a set with a partner Y holds min(L(X) - may_differ(X), L(Y) - may_differ(Y)) tokens there that are among Y's lowest.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    tokens = _sets(texts, n, percent, lowest=True).select("id", F.explode("set").alias("t"))
    held = tokens.groupBy("t").agg(F.min("id").alias("s1"), F.max("id").alias("top")).filter(F.col("s1") == F.col("top"))
    return held.groupBy("s1").agg(F.count(F.lit(1)).alias("lone"))


def _texts_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the nodes (id, __k1, __k2)."""
    small = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_ROWS else nodes
    src = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return src.join(small, ["__k1", "__k2"]).select("id", "text")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return joined.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def may_be_alike(n: str, m: str, n2: str, m2: str, percent: int) -> Column:
    """Whether sets of n and n2 tokens, of which m and m2 are in any other set, may reach the threshold."""
    most = F.least(m, m2)
    return 100 * most >= percent * (F.col(n) + F.col(n2) - most)


def _groups(nodes: DataFrame) -> DataFrame:
    """The nodes (id, n, m, low, c) with the number of their group: those of a component, or with one lowest token, in parts of bounded size.

    How many parts depends on counts, and a node's part on its hash, so no group is gathered to be cut.
    """
    nodes = nodes.withColumn("key", F.when(F.col("linked"), F.xxhash64(F.lit(1), "c")).otherwise(F.xxhash64(F.lit(2), F.get("low", F.lit(0)))))
    weight = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    parts = weight.select("key", F.greatest(F.ceil(F.col("k") / GROUP_NODES), F.ceil(F.col("w") / GROUP_TOKENS)).alias("parts"))
    # Keys with one part need no number; the others are few: at most a thirty-second of the nodes.
    many = materialize(parts.filter("parts > 1"))
    many = F.broadcast(many) if many.count() <= MAX_BROADCAST_ROWS else many
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("parts", F.lit(1)))
    return nodes.join(many, "key", "left").select("id", "n", "m", "c", F.xxhash64("key", part).alias("g"))


def counted_tokens(sets: DataFrame) -> DataFrame:
    """Tokens of one set (id) and tokens of more than FREQUENT sets (t, k); the others are left out."""
    held = sets.select("id", F.explode("set").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))
    frequent = F.col("k") > FREQUENT
    return materialize(held.filter(frequent | (F.col("k") == 1)).select(F.when(~frequent, F.col("id")).alias("id"), F.when(frequent, F.col("t")).alias("t"), "k"))


def frequent_tokens(counted: DataFrame) -> np.ndarray:
    """The most frequent of the tokens of `counted_tokens`, sorted: as many as may be sent to the tasks."""
    top = counted.filter(F.col("t").isNotNull()).orderBy(F.desc("k"), "t").limit(MAX_FREQUENT).select("t")
    return np.sort(top.toPandas()["t"].to_numpy(dtype=np.int64))


def among(frequent: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which of ``tokens`` are in ``frequent``, which is sorted."""
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    return frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens


def _first_tokens(sets: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """(id, t): of each set the first tokens in the common order, as many as may differ and one."""
    last = sets.sparkSession.sparkContext.broadcast(frequent_tokens(counted))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = last.value
        for batch in batches:
            firsts = []
            for value in batch.column("set"):
                tokens = value.values.to_numpy()
                late = among(frequent, tokens)
                tokens = np.concatenate((tokens[~late], tokens[late]))
                firsts.append(tokens[: len(tokens) * (100 - percent) // 100 + 1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(firsts, pa.list_(pa.int64()))], names=["id", "set"])

    return sets.mapInArrow(cut, f"id bigint, set {_SET}").select("id", F.explode("set").alias("t"))


def _qualifying(nodes: DataFrame, sets: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """(q, g): nodes and the groups that may hold a partner of another component, by the bound on the union of the group's tokens."""
    first = materialize(_first_tokens(sets, counted, percent).join(nodes.select("id", "n", "m", "c", "g"), "id"))
    # Only tokens of several components propose anything. Of two partners with different components at least one is not
    # in the component that holds the token most often, so that one asks.
    by_c = first.groupBy("t", "c").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_c.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("k", "c")).alias("most"))
    mixed = materialize(mixed.filter("lo <> hi").select("t", F.col("most.c").alias("most")))
    rows = materialize(first.join(mixed, "t"))
    asks = rows.filter(F.col("c") != F.col("most")).select("t", F.col("id").alias("q"), F.col("n").alias("nq"), F.col("m").alias("mq"), F.col("c").alias("cq"))
    spans = rows.groupBy("t", "g").agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.max("m").alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    own = (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("cq"))
    fits = (100 * F.col("largest") >= percent * F.col("nq")) & (percent * F.col("least") <= 100 * F.col("nq")) & may_be_alike("nq", "mq", "least", "most", percent)
    asked = materialize(asks.join(spans, "t").filter(fits & ~own).select("q", "nq", "g").distinct())
    members = nodes.select("id", "g").join(asked.select("g").distinct(), "g", "left_semi")
    unions = members.join(sets, "id").groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("union"))
    met = F.size(F.array_intersect("set", "union"))
    held = asked.join(sets.withColumnRenamed("id", "q"), "q").join(unions, "g")
    return held.filter(100 * met >= percent * F.col("nq")).select("q", "g")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = 80) -> DataFrame:
    """A row per input row: id, n_shingles, component_id.

    Words stand between ASCII white space, A-Z lower-cased; a document's set is its distinct shingles of ``shingle_words``
    words (with fewer words, the whole as one). Documents with 100 * shared >= ``percent`` * united are linked, and
    component_id is the smallest id reachable. Links that join nothing new are not looked for.

    Null, empty and blank texts have no shingles and are linked with nothing. A null id is its own document: linked with
    nothing, component_id null. Rows that share an id are a document each, linked by their own sets. An empty table gives
    an empty result. Columns other than id and text are not read. Hashes of 64 bits stand for shingles.
    """
    docs = docs.select(id_col, text_col)
    signed = materialize(_signed(docs, id_col, text_col, shingle_words))
    usable = signed.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "__k1", "__k2", "low")).alias("rep"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    # Sets that may have a partner: enough of their lowest tokens are in another set.
    may = may_differ(F.col("n"), percent)
    partner = may_differ(F.ceil(F.col("n") * percent / 100), percent)
    shared = may + F.floor(may / 2) + 1 - F.coalesce("lone", F.lit(0))
    enough = shared >= F.floor(partner / 2) + 1
    lone = _possible(docs.filter(F.col(id_col).isNotNull()), signed, text_col, shingle_words, percent)
    able = materialize(classes.join(lone, "s1", "left").filter(enough).select(F.col("node").alias("id"), "n", "rep.low", "rep.__k1", "rep.__k2"))
    sets = materialize(_sets(_texts_of(able.select("id", "__k1", "__k2"), docs, id_col, text_col), shingle_words, percent, lowest=False))
    if sets.count() > able.count():  # equal rows share a key; one of them is enough
        sets = materialize(sets.dropDuplicates(["id"]))
    counted = counted_tokens(sets)
    own = counted.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    able = able.select("id", "n", "low").join(own, "id", "left").select("id", "n", "low", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))
    able = materialize(able.filter(100 * F.col("m") >= percent * F.col("n")))
    # Links to hubs first.
    keyed = able.select("id", "n", "m", F.explode("low").alias("t"))
    central = F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("id")).alias("id"), "n", "m")
    hubs = keyed.groupBy("t").agg(F.max(central).alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    hubs = hubs.select("t", (-F.col("hub.id")).alias("a"), F.col("hub.n").alias("na"), F.col("hub.m").alias("ma"))
    stars = keyed.join(hubs, "t").filter((F.col("id") != F.col("a")) & may_be_alike("n", "m", "na", "ma", percent))
    edges = materialize(_confirmed(stars.select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct(), sets, percent))
    label = components(edges)
    labelled = able.join(label, "id", "left")
    nodes = materialize(_groups(labelled.select("id", "n", "m", "low", F.coalesce("component", "id").alias("c"), F.col("component").isNotNull().alias("linked"))))
    # Then the groups that hold another component.
    opened = materialize(_qualifying(nodes, sets, counted, percent))
    asking = opened.join(nodes.select(F.col("id").alias("q"), F.col("n").alias("nq"), F.col("m").alias("mq"), F.col("c").alias("cq")), "q")
    within = may_be_alike("n", "m", "nq", "mq", percent) & (F.col("c") != F.col("cq"))
    pairs = asking.join(nodes, "g").filter(within).select(F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b")).distinct()
    more = materialize(_confirmed(pairs, sets, percent))
    if more.limit(1).count():
        label = components(edges.union(more))
    # Back to rows: the least id of each component.
    members = materialize(classes.join(label, F.col("node") == F.col("id"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("c3"), F.col("rep.id").alias("least"), "component"))
    linked = members.filter(F.col("component").isNotNull())
    smallest = materialize(linked.groupBy("component").agg(F.min("least").alias("smallest")))
    final = linked.join(smallest, "component").select("c1", "c2", "c3", "smallest")
    same_set = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("c3"))
    # A copy of a set that is linked with no other has the least id of its own copies.
    final = materialize(final.union(members.filter(F.col("component").isNull()).select("c1", "c2", "c3", "least")))
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return signed.select("id", "n", "s1", "s2").join(final, same_set & ~alone, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("smallest", "id").alias("component_id"))


@query(
    "op12_ngram_join",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(4, len(w)) - 1], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id
      HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
    reach AS (SELECT doc_id AS id, doc_id AS node FROM words UNION SELECT id, b FROM reach JOIN links ON node = a)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(node) AS component_id
    FROM words w JOIN reach ON id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id, n
    """,
)
def op12_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"), percent=85)
