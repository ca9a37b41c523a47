"""Tokenizer alignment, n-gram join, spelling variants: each against a plain version."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronopanel.llm.alignment import TOKENIZERS, ByteLevel, _names, align, byte_of_symbol, tokenizer_alignment
from chronopanel.llm.ngram_join import ngram_join
from chronopanel.llm.spelling import run_counts, spelling_variants, vector
from tests.llm import brute
from tests.llm.conftest import EDGE, PROSE, REPEATED, frame, rows_of


def sort(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- n-gram join ---------------------------------------------------------------------

def joined(rows, percent):
    return [(i, n, c) for i, n, c, _ in brute.near_duplicates(rows, percent, 4)]


@pytest.mark.parametrize("percent", [80, 85])
def test_ngram_join(small, percent):
    df, rows = small
    assert rows_of(ngram_join(df, percent=percent), "doc_id", "n_shingles", "component_id") == sort(joined([(i, t) for i, t, _ in rows], percent))


def test_ngram_join_edge(edge):
    assert rows_of(ngram_join(edge), "doc_id", "n_shingles", "component_id") == sort(joined([(i, t) for i, t, _ in EDGE], 80))


def test_ngram_join_repeated_ids(repeated):
    out = defaultdict(list)
    for r in ngram_join(repeated).collect():
        out[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert len(out[4]) == 2 and {c for _, c in out[4] + out[5] + out[6]} == {4} and len(out[7]) == 3 and sum(map(len, out.values())) == len(REPEATED)


def test_ngram_join_at_the_threshold(spark):
    """Pairs on both sides of the threshold, of unequal sizes, and a chain; a passage that all share."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for k in range(12):
        base = [f"d{k}w{i}" for i in range(rng.randrange(12, 300))]
        rows.append(base + passage)
        for cut in (1, 2, 5, 9, 20, 31):
            other = list(base)
            for at in rng.sample(range(len(base)), min(cut, len(base))):
                other[at] = f"x{k}y{cut}z{at}"
            rows.append(other[: len(other) - cut // 2] + passage)
    chain = [f"t{i}" for i in range(330)]
    rows += [chain[k * 5 : k * 5 + 200] for k in range(15)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    for percent in (80, 85):
        got = rows_of(ngram_join(frame(spark, [(i, t, "s") for i, t in rows]), percent=percent), "doc_id", "n_shingles", "component_id")
        assert got == sort(joined(rows, percent))


# --- spelling variants ----------------------------------------------------------------

def spelled(counts: dict, factor: int = 5) -> list:
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    out, forms = [], {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= factor * n and counts[best] > n else None
        out.append((w, n, len(others)))
    rows = []
    for w, n, k in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, k, counts[forms[w]] if forms[w] is not None else None))
    return rows


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants(spark):
    rng = random.Random(3)
    words = ["aabbcc", "ééàü", "À", "", "b", "ab", "z" * 34, "z" * 35, "z" * 36, "z" * 37, "z" * 36 + "a", "9-4", "9-44", "żółw", "żółty", "żółwy", "\U0001f600x", "x"]
    for _ in range(40):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
        words.append(w)
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            words += [w[:i] + rng.choice("abxyÀ") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :], w[:i] + w[i + 1 :], "".join(rng.sample(w, len(w)))]
    counts = {w: rng.choice([1, 2, 5, 9, 30, 200, 1200]) for w in words}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 9, "x")], "word string, n bigint, form string")
    assert rows_of(spelling_variants(df), *COLUMNS) == sort(spelled(counts))


def test_spelling_of_repeated_words_and_empty_table(spark):
    df = spark.createDataFrame([("letter", 3), ("letter", 40), ("lettre", None), ("leter", 4), ("leter", 1)], "word string, n bigint")
    assert rows_of(spelling_variants(df), *COLUMNS) == sort(spelled({"letter": 43, "lettre": 0, "leter": 5}))
    assert spelling_variants(df.limit(0)).count() == 0


def test_vector(spark):
    row = spark.createDataFrame([("abzé",), ("a" * 50,)], "w string").select(vector(F.col("w"))).collect()
    assert all(len(r[0]) == 24 for r in row) and "z" in row[1][0] and sum(int(c, 36) for c in row[0][0]) == 4


def test_run_counts(small, edge):
    for df, rows in ((small[0], small[1]), (edge, EDGE)):
        want = Counter()
        for id_, text, *_ in rows:
            for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
                run = run.translate(brute.LOWER)
                h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
                want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
        assert rows_of(run_counts(df), "word", "n") == sort((w, n) for w, n in want.items() if len(w) >= 6 and n >= 5)


# --- tokenizer alignment -----------------------------------------------------------------

def aligned(texts: list) -> list:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    one = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    symbol = byte_of_symbol()
    all_links, shown = [], []
    for t in texts:
        links, groups, a, b = [], [], [], []
        if t:
            a = [(i, bytes(symbol[c] for c in one.id_to_token(i))) for i in one.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(t)]
            if b"".join(x for _, x in a) != (" " + t).encode() or b"".join(x for _, x in b) != (" " + t).encode():
                a, b = [], []
        ends = []
        for side in (a, b):
            at, out = 0, {}
            for k, (i, x) in enumerate(side):
                at += len(x)
                out[at] = (k, i)
            ends.append(out)
        i = j = 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            (k, x), (m, y) = ends[0][e], ends[1][e]
            links.append((x, y))
            groups.append(",".join(str(v) for v, _ in a[i : k + 1]) + "|" + ",".join(str(v) for v, _ in b[j : m + 1]))
            i, j = k + 1, m + 1
        all_links.append(links)
        shown.append((len(a), len(b), ";".join(groups)))
    count = Counter(x for links in all_links for x in links)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), g or None)
            for links, (n_a, n_b, g) in zip(all_links, shown, strict=True)]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_alignment(small):
    df, rows = small
    want = [(i, *m) for (i, _, _), m in zip(rows, aligned([t for _, t, _ in rows]), strict=True)]
    assert rows_of(tokenizer_alignment(df), "doc_id", *ALIGNED) == sort(want)


def test_alignment_edge(spark, nothing):
    rows = [*REPEATED, (30, "<|endoftext|> <s> </s>\n<0x0A>", "a"), (31, "▁ ▁▁x", "a"), (32, " ", "a"), (33, "a\x00b﻿ ", "b"), (34, "tab\t\ttab  é \U0001f469‍\U0001f467", "b")]
    rows += [(40 + k, "the same short text", "a") for k in range(30)]
    want = [(i, *m) for (i, _, _), m in zip(rows, aligned([t for _, t, _ in rows]), strict=True)]
    assert rows_of(tokenizer_alignment(frame(spark, rows)), "doc_id", *ALIGNED) == sort(want)
    digest = F.sha2(F.col("groups").cast("binary"), 256)
    got = {r[0] for r in tokenizer_alignment(frame(spark, rows[:1] + rows[-1:]), shown=digest).select("groups").collect()}
    assert got == {None, hashlib.sha256(want[-1][-1].encode()).hexdigest()}
    assert tokenizer_alignment(nothing).count() == 0


def test_byte_level_ids_are_those_of_the_file():
    """Random text of all planes against the library that the file is made for."""
    one = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    one.encode_special_tokens = True
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", "rb") as f:
        ours = ByteLevel(f.read())
    rng, odd = random.Random(1), [0x20, 9, 10, 13, 0x85, 0xA0, 0x2028, 0x3000, 0x180E, 0x200B, 0x1680]
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.choice(odd), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x1FFFF)]))
                     for _ in range(rng.randrange(1, 14))) for _ in range(5000)] + ["<|endoftext|>", "don't we'll I'M 1234 ...\n\n  x"]
    assert ours.encode(texts) == [one.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_tokens_without_bytes():
    import numpy as np

    sizes, bars, ends = np.array([0, 1, 2]), _names(3, "|"), _names(3, ";")
    assert align([], [], sizes, sizes, bars, ends)[0] == ""
    shown, left, right = align([1, 1, 0], [2], sizes, sizes, bars, ends)
    assert shown == "1,1,0|2" and sort(zip(left.tolist(), right.tolist())) == [(0, 2), (1, 2)]


def test_long_text_is_aligned_whole(spark):
    text = PROSE * 40
    r = tokenizer_alignment(frame(spark, [(1, text, "a")])).first()
    assert r["groups"].count(";") + 1 == r["n_groups"] and sum(len(g.split("|")[0].split(",")) for g in r["groups"].split(";")) == r["n_a"]


def test_alignment_writes_no_string_per_token():
    """Names are rows of bytes, so a text's groups are put together without an object for each of its tokens."""
    import numpy as np

    digits, mark = _names(12, "|")
    assert digits.dtype == np.uint8 and bytes(digits[11][digits[11] != 0]) == b"11" and mark == ord("|")
    sizes = np.array([1, 2, 3] + [1] * 9)
    shown, left, right = align([11, 1, 2], [10, 2, 1], sizes, sizes, _names(12, "|"), _names(12, ";"))
    assert (shown, left.tolist(), right.tolist()) == ("11|10;1,2|2,1", [11, 2], [10, 1])
