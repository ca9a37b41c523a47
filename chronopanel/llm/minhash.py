"""Near-duplicates by b-bit MinHash.

Of each document's set of word shingles, the minima of many hash functions are taken. Full minima only make the band
keys; what is kept of each is its lowest bits, packed into whole numbers. Documents that share a band key are
candidates, their similarity is estimated by counting equal bits, corrected for bits that agree by chance, and the
pairs that may reach the threshold are confirmed on full sets.

Equal sets are one representative from the start. Within a band's group a star of candidates goes to the member with the
most shingles that many others have: of copies of a text with changes here and there, that text. Pairs that the stars left
in different components are then looked at too, behind exact bounds on what they can share: what a document alone holds
it shares with none, and where frequent shingles are too few, a rare one is shared. So a group of n near copies costs
about n candidates per band, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.components import components
from chronopanel.llm.decontamination import row_key
from chronopanel.llm.hashing import SPACED, gram_hashes, in_pieces, mix, numbers, word_hashes
from chronopanel.llm.ngram_join import among, counted_tokens, frequent_tokens, may_be_alike
from chronopanel.llm.registry import query, table
from chronopanel.session import materialize

SHINGLE_WORDS = 5
# 32 bands of 5 minima: at a similarity of 0.85 a pair shares no band with probability 7e-9, at 0.8 with 3e-6.
BANDS, ROWS = 32, 5
BITS = 2
PER_LONG = 64 // BITS
# Estimates stray from the truth by 0.033 (standard deviation at 0.85); pairs this far below are not confirmed.
SLACK = 0.17
# Rows of a side that may be broadcast: a row key and a number of a set, 24 bytes each.
MAX_BROADCAST_ROWS = 100_000

_SET = "array<bigint>"


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; all words as one if they are fewer, none if none."""
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))


class Signer:
    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        self.factors = numbers(11, bands * rows)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 256):
            np.minimum(low, (shingles[at : at + 256, None] * self.factors).min(axis=0), out=low)
        return low

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        out = numbers(13, self.bands)
        for part in minima.reshape(self.bands, self.rows).T:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
        return out

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The lowest bits of each minimum, PER_LONG to a number; what is over is 0."""
        low = np.zeros(-(-len(minima) // PER_LONG) * PER_LONG, np.uint64)
        low[: len(minima)] = mix(minima) & np.uint64((1 << BITS) - 1)
        shift = (np.arange(PER_LONG) * BITS).astype(np.uint64)
        return np.bitwise_or.reduce(low.reshape(-1, PER_LONG) << shift, axis=1)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, __k1 and __k2 (`row_key`), n_shingles, s1 and s2 (128 bits that stand for the set), sig (packed bits), bands."""
    signer = Signer(bands, rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, ["id", "__k1", "__k2"], "text"):
            n, s1, s2, sig, keys = [], [], [], [], []
            for words in word_hashes(texts, SPACED):
                shingles = shingle_set(words, shingle_words)
                n.append(len(shingles))
                if not len(shingles):
                    s1.append(0), s2.append(0), sig.append(None), keys.append(None)
                    continue
                s1.append(int(np.add.reduce(mix(shingles)).astype(np.int64)))
                s2.append(int(np.add.reduce(mix(shingles ^ np.uint64(0x5555555555555555))).astype(np.int64)))
                low = signer.minima(shingles)
                sig.append(signer.packed(low).astype(np.int64))
                keys.append(signer.band_keys(low).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids["id"], ids["__k1"], ids["__k2"], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(sig, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "__k1", "__k2", "n_shingles", "s1", "s2", "sig", "bands"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), *row_key(id_col, text_col), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(sign, f"id {kind}, __k1 bigint, __k2 bigint, n_shingles bigint, s1 bigint, s2 bigint, sig {_SET}, bands {_SET}")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, set) per row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, ["id"], "text"):
            sets = [shingle_set(w, shingle_words).astype(np.int64) for w in word_hashes(texts, SPACED)]
            yield pa.RecordBatch.from_arrays([ids["id"], pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return src.mapInArrow(cut, f"id {dict(src.dtypes)['id']}, set {_SET}")


def estimate(sig_a: str, sig_b: str, minima: int) -> Column:
    """Similarity from packed bits: the share of equal minima, less what agrees by chance."""
    longs = -(-minima // PER_LONG)
    odd = 0x5555555555555555
    unlike = F.lit(0)
    for i in range(longs):
        x = f"({sig_a}[{i}] ^ {sig_b}[{i}])"
        unlike = unlike + F.expr(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {odd})")
    chance = 1 / (1 << BITS)
    return ((1 - unlike / minima) - chance) / (1 - chance)


def _likely(minima: int, percent: int) -> Column:
    """Whether sizes and signatures (na, nb, sa, sb) let a pair reach the threshold."""
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("sa", "sb", minima) >= percent / 100 - SLACK)


def _sets_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, set) of the nodes in ``nodes`` (__w), stored. ``reps`` has the key of a row that holds the set."""
    wanted = materialize(reps.join(nodes.distinct(), F.col("id") == F.col("__w"), "left_semi").select("id", "__k1", "__k2"))
    n = wanted.count()
    wanted = F.broadcast(wanted) if n <= MAX_BROADCAST_ROWS else wanted
    texts = docs.select(F.col(f"`{text_col}`").alias("__t"), *row_key(id_col, text_col)).join(wanted, ["__k1", "__k2"])
    found = materialize(shingle_sets(texts, "id", "__t", shingle_words))
    # Equal rows share a key; one of them is enough.
    return found if found.count() == n else materialize(found.dropDuplicates(["id"]))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return joined.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _measured(sets: DataFrame, percent: int) -> DataFrame:
    """Per document of ``sets`` that may have a partner there, stored: id, n (shingles), m (those that another one has too),
    f (those of many) and rare: of its first shingles, as many as may differ and one, with those of many last, those that are not of many."""
    counted = counted_tokens(sets)
    sent = sets.sparkSession.sparkContext.broadcast(frequent_tokens(counted))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            n, f, rare = [], [], []
            for value in batch.column("set"):
                shingles = value.values.to_numpy()
                of_many = among(frequent, shingles)
                n.append(len(shingles)), f.append(int(of_many.sum()))
                rare.append(shingles[~of_many][: len(shingles) * (100 - percent) // 100 + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], names=["id", "n", "f", "rare"])

    own = counted.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    found = sets.mapInArrow(cut, f"id bigint, n bigint, f bigint, rare {_SET}").join(own, "id", "left")
    found = found.select("id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"), "f", "rare")
    return materialize(found.filter(100 * F.col("m") >= percent * F.col("n")))


def _mixed(keys: DataFrame) -> DataFrame:
    """Those of the rows (id, c, band, key) whose band group holds more than one component c."""
    groups = keys.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter(F.col("lo") != F.col("hi")).select("band", "key")
    return materialize(keys.join(materialize(groups), ["band", "key"], "left_semi"))


def _across(keys: DataFrame, nodes: DataFrame, reps: DataFrame, minima: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a band and may reach the threshold.

    ``keys`` are the rows (id, c, band, key) of mixed band groups, ``nodes`` has their numbers and rare shingles
    (`_measured`), ``reps`` id, sig and all bands. The pairs are of two kinds. Shingles of many alone may suffice for the
    threshold: then the band groups are gone through, by documents that have so many. Or they do not: then a pair
    shares a shingle that is not of many, and the first such one in the common order is among the first of both
    sides, so documents meet by these, and no group is large. All conditions hold within the joins.
    """
    wide = reps.select("id", "sig", "bands")
    enough = nodes.filter(100 * F.col("f") >= percent * F.col("n")).select("id", "n", "f")
    rows = _mixed(keys.join(enough, "id")).join(wide, "id")
    rows = materialize(rows.select("id", "c", "band", "key", "n", "f", "sig", F.slice("bands", F.lit(1), F.col("band")).alias("before")))
    held = keys.select("id", "c").distinct().join(nodes.select("id", "n", "m", "f", F.explode("rare").alias("t")), "id")
    held = materialize(held)
    several = held.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("t")
    met = materialize(held.join(several, "t", "left_semi").join(wide, "id"))

    def side(of: DataFrame, x: str) -> DataFrame:
        return of.select(*[F.col(c).alias(x if c == "id" else f"{c}{x}") for c in of.columns])

    def pairs(of: DataFrame, on: Column) -> DataFrame:
        sizes_and_bits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("siga", "sigb", minima) >= percent / 100 - SLACK)
        return side(of, "a").join(side(of, "b"), on & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes_and_bits).select("a", "b")

    by_many = may_be_alike("na", "fa", "nb", "fb", percent)
    band_in = lambda x, y: F.exists(F.zip_with(x, y, lambda u, v: u == v), lambda same: same)
    in_band = pairs(rows, (F.col("banda") == F.col("bandb")) & (F.col("keya") == F.col("keyb")) & by_many & ~band_in("beforea", "beforeb"))
    by_rare = pairs(met, (F.col("ta") == F.col("tb")) & ~by_many & may_be_alike("na", "ma", "nb", "mb", percent) & band_in("bandsa", "bandsb"))
    return in_band.unionByName(by_rare.distinct())


def _decided(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """A row per input row: id, __k1 and __k2 (`row_key`), n_shingles, component_id, kept. Settled as in `near_duplicates`."""
    docs = docs.select(id_col, text_col)
    signed = materialize(signatures(docs, id_col, text_col, shingle_words, bands, rows))
    usable = signed.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    row = F.struct("id", "__k1", "__k2")
    # One node for each distinct set, with its least row. Copies are added up before anything is dealt out; a node's
    # number holds because it is stored. From here to the labels, id is that number.
    classes = usable.groupBy("s1", "s2", "n_shingles").agg(F.min(row).alias("rep"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    reps = materialize(
        usable.drop("id").join(classes.select("node", F.col("rep.__k1").alias("__k1"), F.col("rep.__k2").alias("__k2")), ["__k1", "__k2"])
        .dropDuplicates(["node"]).select(F.col("node").alias("id"), "__k1", "__k2", "n_shingles", "sig", "bands"))
    minima = bands * rows
    in_bands = reps.select("id", F.posexplode("bands").alias("band", "key"))
    groups = in_bands.groupBy("band", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("band", "key")
    shared = materialize(in_bands.join(groups, ["band", "key"], "left_semi"))
    sets = _sets_of(shared.select(F.col("id").alias("__w")), reps, docs, id_col, text_col, shingle_words)
    nodes = _measured(sets, percent)
    shared = materialize(shared.join(nodes.select("id", "n", "m", "f"), "id"))
    side = reps.select("id", F.col("n_shingles").alias("n"), "sig").join(nodes.select("id"), "id", "left_semi")
    central = F.struct((F.col("f") / F.col("n")).alias("f_share"), (F.col("m") / F.col("n")).alias("m_share"), (-F.col("id")).alias("id"), "n", "m")
    hubs = shared.groupBy("band", "key").agg(F.max(central).alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    hubs = hubs.select("band", "key", (-F.col("hub.id")).alias("a"), F.col("hub.n").alias("na"), F.col("hub.m").alias("ma"))
    stars = shared.join(hubs, ["band", "key"]).filter((F.col("id") != F.col("a")) & may_be_alike("n", "m", "na", "ma", percent))
    stars = stars.select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct()

    def likely(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
            .join(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
            .filter(_likely(minima, percent)).select("a", "b")
        )

    first = materialize(likely(stars))
    edges = materialize(_confirm(first, sets, percent))
    label = components(edges)
    # Groups whose stars left more than one component: the pairs across components are looked at as well.
    keys = _mixed(shared.select("id", "band", "key").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "band", "key"))
    second = materialize(_across(keys, nodes, reps, minima, percent).join(first, ["a", "b"], "left_anti"))
    if second.limit(1).count():
        label = components(edges.union(_confirm(second, sets, percent)))
    # The least row of each component; a set that is linked with no other has its own.
    members = materialize(classes.join(label, F.col("node") == F.col("id"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("c3"), "rep", "component"))
    linked = members.filter(F.col("component").isNotNull())
    least = materialize(linked.groupBy("component").agg(F.min("rep").alias("least")))
    final = linked.join(least, "component").select("c1", "c2", "c3", "least").union(
        members.filter(F.col("component").isNull()).select("c1", "c2", "c3", "rep"))
    lone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    same_set = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") == F.col("c3"))
    return (
        signed.select("id", "__k1", "__k2", "n_shingles", "s1", "s2").join(final, same_set & ~lone, "left")
        .select("id", "__k1", "__k2", "n_shingles", F.coalesce("least.id", "id").alias("component_id"),
                F.coalesce(row == F.col("least"), F.lit(True)).alias("kept"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per input row: id, n_shingles, component_id, kept.

    Words stand between ASCII white space, A-Z lower-cased; a document's set is its distinct shingles of
    ``shingle_words`` words (with fewer words, the whole as one). Documents with 100 * shared >= ``percent`` * united
    are linked, component_id is the smallest id reachable, and kept marks the row that has it.

    Null, empty and blank texts have no shingles, are linked with nothing and kept. A null id is its own document:
    linked with nothing, component_id null, kept. Rows that share an id are a document each, linked by their own sets:
    of those in one component with its smallest id, kept marks the one of the least row key (and rows equal to it), and
    components that are not linked may have the same component_id. An empty table gives an empty result.
    Columns other than id and text are not read.
    """
    found = _decided(docs, id_col, text_col, shingle_words, percent, bands, rows)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                         percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one that `near_duplicates` keeps; all columns are kept.

    What goes is decided row by row, so texts that are not alike all stay, also under one id. Of equal rows (id and text)
    one stays. Null ids and texts without words are groups of their own, and all their rows stay, whatever id they share.
    """
    keys = ["__k1", "__k2"]
    found = materialize(_decided(docs, id_col, text_col, shingle_words, percent, bands, rows))
    narrow = found.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).select(*keys, "kept")
    gone = materialize(narrow.filter(~F.col("kept")).select(*keys).distinct())
    twice = materialize(narrow.filter("kept").groupBy(*keys).count().filter("count > 1").select(*keys))
    small = lambda t: F.broadcast(t) if t.count() <= MAX_BROADCAST_ROWS else t
    # The caller's columns travel in a struct, so that none clashes with those in use here.
    left = docs.select(F.struct("*").alias("__row"), *row_key(id_col, text_col)).join(small(gone), keys, "left_anti")
    if twice.limit(1).count():
        few = small(twice)
        again = left.join(few, keys, "left_semi").groupBy(*keys).agg(F.min("__row").alias("__row"))
        left = left.join(few, keys, "left_anti").select("__row").unionByName(again.select("__row"))
    return left.select("__row.*")


@query(
    "op2_minhash_near_dedup",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id
      HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
    reach AS (SELECT doc_id AS id, doc_id AS node FROM words UNION SELECT id, b FROM reach JOIN links ON node = a)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(node) AS component_id, w.doc_id = min(node) AS kept
    FROM words w JOIN reach ON id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id, n
    """,
)
def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
