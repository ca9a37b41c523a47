"""Operators that can be held against a plain version row by row."""

import random

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import minhash
from chronopanel.llm.decontamination import contamination, drop_contaminated
from chronopanel.llm.license_scan import Template, license_scan, license_spans
from chronopanel.llm.line_dedup import line_dedup
from chronopanel.llm.minhash import drop_near_duplicates, near_duplicates
from chronopanel.llm.quality_rules import quality_filter, text_counts
from chronopanel.llm.repeats import remove_repeats
from tests.llm import brute
from tests.llm.conftest import EDGE, LINE, PROSE, REPEATED, frame, rows_of

INPUTS = [("edge", EDGE), ("repeated", REPEATED)]
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def sort(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name,rows", INPUTS)
def test_line_dedup(request, name, rows):
    got = rows_of(line_dedup(request.getfixturevalue(name), min_docs=4), "doc_id", "n_lines", "n_dropped", "text")
    want = brute.kept_lines([(i, t) for i, t, _ in rows], 40, 4)
    assert got == sort((i, *w) for (i, _, _), w in zip(rows, want, strict=True))


@pytest.mark.parametrize("name,rows", INPUTS)
def test_text_counts(request, name, rows):
    got = rows_of(text_counts(request.getfixturevalue(name)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sort((i, *brute.text_counts(t)) for i, t, _ in rows)


@pytest.mark.parametrize("name,rows", INPUTS)
def test_license_base(request, name, rows):
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = rows_of(license_scan(request.getfixturevalue(name)), "doc_id", *columns)
    assert got == sort((i, *(brute.phrase_places(t, PHRASES)[c] for c in columns)) for i, t, _ in rows)


def test_license_diagonals(spark):
    body = " ".join(f"term{i}" for i in range(60))
    changed = body.replace("term20", "other").replace("term40 ", "term40 inserted words here ")
    docs = frame(spark, [(1, "before " + body + " after", "a"), (2, "x " + changed, "a"), (3, " ".join(f"term{i}" for i in range(0, 60, 2)), "a"), (4, body + " " + body, "a")])
    template = Template("own", body)
    spans = rows_of(license_spans(docs, [template]), "__id", "label", "first", "last")
    assert [s for s in spans if s[0] != 4] == [(1, "own", 1, 60), (2, "own", 1, 63)]
    assert {s[2] for s in spans if s[0] == 4} == {0, 60}
    out = {r["doc_id"]: r for r in license_scan(docs, [template]).collect()}
    assert out[1]["score"] == 1.0 and 0.9 < out[2]["score"] < 1 and out[3]["score"] == 0 and out[3]["labels"] == ""


@pytest.mark.parametrize("name,rows", INPUTS)
def test_remove_repeats(request, name, rows):
    got = rows_of(remove_repeats(request.getfixturevalue(name), length=64, gram=24), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sort((i, *w) for (i, _, _), w in zip(rows, brute.removed_repeats([t for _, t, _ in rows], 64), strict=True))


def test_remove_repeats_small_table(small):
    df, rows = small
    got = rows_of(remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sort((i, *w) for (i, _, _), w in zip(rows, brute.removed_repeats([t for _, t, _ in rows], 400), strict=True))


def test_repeats_in_pieces(spark, monkeypatch):
    """A text longer than a piece, with a repeat across the edge."""
    from chronopanel.llm import repeats

    rng = random.Random(5)
    block, text = ("".join(rng.choices("abcdefgh ", k=n)) for n in (500, 3000))
    rows = [(1, text[:1900] + block + text[1900:], "a"), (2, block, "a")]
    whole = [list(x) for x in zip(*[p for part in repeats.segments(rows[0][1].encode(), 400, 128) for p in zip(*part, strict=True)], strict=True)]
    monkeypatch.setattr(repeats, "PIECE", 1000)
    cut = [list(x) for x in zip(*[p for part in repeats.segments(rows[0][1].encode(), 400, 128) for p in zip(*part, strict=True)], strict=True)]
    starts = lambda s: [w for lo, hi in zip(s[3], s[4], strict=True) for w in range(lo, hi + 1)]
    assert starts(whole) == starts(cut) == list(range(len(rows[0][1]) - 399))
    monkeypatch.undo()
    got = rows_of(remove_repeats(frame(spark, rows)), "doc_id", "n_removed", "n_spans")
    assert got == [(1, 500, 1), (2, 500, 1)]


@pytest.mark.parametrize("window", [3, 10])
@pytest.mark.parametrize("name,rows", INPUTS)
def test_contamination(request, spark, name, rows, window):
    items = [(1, "MIT license"), (2, " ".join(PROSE.split()[30:55])), (3, None), (4, ""), (None, "one two three one"), (2, LINE.upper()), (5, "zzz"), (6, "one"), (10, "plain plain")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit(1)).withColumn("__n", F.lit(1))
    df = request.getfixturevalue(name)
    # Two windows to a block: the answer must not depend on how items are cut into blocks.
    out = contamination(df, table, window=window, block_windows=20 if window == 3 else 200_000)
    want = [(i, *brute.contamination(t, items, window)) for i, t, _ in rows]
    assert rows_of(out, "doc_id", "n_words", "n_hit", "items") == sort(want)
    if window == 10:
        left = drop_contaminated(df, table)
        assert left.columns == df.columns
        assert rows_of(left, "doc_id", "text") == sort((i, t) for (i, t, _), w in zip(rows, want, strict=True) if not w[2])


def test_contamination_without_items(spark, edge):
    items = spark.createDataFrame([], "item_id bigint, text string")
    out = contamination(edge, items)
    assert out.count() == len(EDGE) and not out.filter("n_hit > 0").count()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(small, percent):
    df, rows = small
    got = rows_of(near_duplicates(df, percent=percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sort(brute.near_duplicates([(i, t) for i, t, _ in rows], percent))


def test_near_duplicates_edge(edge):
    got = rows_of(near_duplicates(edge), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sort(brute.near_duplicates([(i, t) for i, t, _ in EDGE], 80))


def test_near_duplicates_repeated_rows(repeated):
    out = {}
    for r in near_duplicates(repeated).collect():
        out.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert out[4] == [(416, 4, True)] * 2
    assert len(out[7]) == 3 and all(c == 7 and k for _, c, k in out[7])
    left = drop_near_duplicates(repeated)
    assert left.columns == repeated.columns
    ids = sorted(r["doc_id"] for r in left.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids.count(4) == 1 and 5 not in ids and {1, 2, 3} <= set(ids)
    # Two different texts under id 7: both stay.
    assert rows_of(left.filter("doc_id = 7"), "text") == [("MIT License",), ("another text under id seven",)]


NULLS = [(None, "5"), (5, None), (None, None), (5, "5"), (None, "5 and four more words follow it"), (5, None)]


def test_rows_that_differ_in_where_they_are_null(spark):
    df = frame(spark, [(i, t, "a") for i, t in NULLS])
    items = spark.createDataFrame([(1, "5")], "item_id bigint, text string")
    got = rows_of(contamination(df, items), "doc_id", "n_words", "n_hit")
    assert got == sort((i, len((t or "").split()), int("5" in (t or ""))) for i, t in NULLS)
    assert rows_of(drop_contaminated(df, items), "doc_id", "text") == sort([(5, None), (5, None), (None, None)])
    assert rows_of(drop_near_duplicates(df), "doc_id", "text") == sort(NULLS)
    assert remove_repeats(df).count() == len(NULLS)


def test_template_with_a_backslash(spark):
    found = license_scan(frame(spark, [(1, "alpha\\beta gamma delta", "a"), (2, "alpha beta gamma delta", "a")]), [Template("x", "alpha\\beta gamma delta", 2, 1.0)])
    assert rows_of(found, "doc_id", "labels") == [(1, "x"), (2, "x")]


def test_near_duplicates_decide_by_row(spark):
    """Texts that are not alike stay, also where another row of their id goes or is kept."""
    other, third = (" ".join(f"{x}{i}" for i in range(300)) for x in "pq")
    rows = [(3, PROSE, "a"), (5, PROSE + " and one more", "b"), (5, other, "c"), (6, other + " more", "a"), (3, third, "b"), (3, PROSE + " tail", "b"),
            (3, PROSE, "d"), (5, " ", "a"), (5, None, "a"), (5, " ", "a"), (None, PROSE, "a"), (None, PROSE, "a")]
    df = frame(spark, rows)
    got = {(r["n_shingles"], r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect() if r["n_shingles"] and r["doc_id"] is not None}
    assert {(i, c) for n, i, c in got if n < 400} == {(5, 5), (6, 5), (3, 3)} and {(i, c) for n, i, c in got if n > 400} == {(3, 3), (5, 3)}
    left = rows_of(drop_near_duplicates(df), "doc_id", "text")
    one = [r for r in left if r[0] == 3 and r[1].startswith(PROSE)]
    assert len(one) == 1
    assert sort(r for r in left if r not in one) == sort(
        [(5, other), (3, third), (5, " "), (5, None), (5, " "), (None, PROSE), (None, PROSE)])


def test_near_copies_of_one_text_are_not_held_against_each_other(spark, monkeypatch):
    """Copies with changes here and there are like their text, which has the largest id, but not like each other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(10_000, " ".join(base), "s")]
    for i in range(1, 161):
        copy = base[:]
        for at in rng.sample(range(5, 145), 2 + i % 3):
            # Some changes are made in more than one copy.
            copy[at] = f"x{at}" if rng.random() < 0.1 else f"x{at}of{i}"
        rows.append((i, " ".join(copy), "s"))
    seen, across = [], minhash._across

    def counted(*args):
        found = across(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(minhash, "_across", counted)
    got = rows_of(near_duplicates(frame(spark, rows), percent=85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sort(brute.near_duplicates([(i, t) for i, t, _ in rows], 85))
    assert seen[0] < len(rows)


def test_near_duplicate_chain_through_missing_hub(spark):
    """b and c are alike, the smallest document a is like neither but shares bands with both."""
    base = [f"t{i}" for i in range(400)]
    a = base[:300] + [f"a{i}" for i in range(100)]
    b = base[:]
    c = base[:396] + ["c1", "c2", "c3", "c4"]
    d = base[:380] + [f"d{i}" for i in range(20)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate([a, b, c, d], 1)]
    got = rows_of(near_duplicates(frame(spark, rows), percent=85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sort(brute.near_duplicates([(i, t) for i, t, _ in rows], 85))


def test_long_chain_of_links(spark):
    words = [f"t{i}" for i in range(330)]
    rows = [(100 - k, " ".join(words[k * 5 : k * 5 + 200]), "s") for k in range(20)]
    got = rows_of(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    want = sort(brute.near_duplicates([(i, t) for i, t, _ in rows], 80))
    assert got == want and {w[2] for w in want} == {81}


def test_quality_filter(spark):
    good = [(i, " ".join(f"word{(i * 31 + k * k) % 997} and" for k in range(60)) + ".", "a") for i in range(60)]
    bad = [(100, " ".join(f"x{k}$$$ y{k}&&&" for k in range(60)), "a"), (101, " ".join(["same"] * 200), "a"), (102, " ".join(f"SHOUT{k}!!" for k in range(80)), "a"), (103, "few words", "a"), (104, None, "a")]
    out = {r["doc_id"]: r for r in quality_filter(frame(spark, good + bad)).collect()}
    assert all(out[i]["kept"] for i in range(60))
    assert not any(out[i]["kept"] for i in range(100, 105))
    assert not out[100]["base_failed"] and out[101]["base_failed"] and out[103]["base_failed"] and out[104]["base_failed"]


def test_empty_tables(spark, nothing):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    for out in (line_dedup(nothing), quality_filter(nothing), license_scan(nothing), remove_repeats(nothing), near_duplicates(nothing),
                contamination(nothing, items), drop_contaminated(nothing, items), drop_near_duplicates(nothing)):
        assert out.count() == 0
