import importlib

import pytest

from reportmill.llm import substrings as S
from tests.llm.odd import ROWS, SCHEMA, documents

PASSAGE = " ".join(f"p{i % 71}q{i}" + ("." if i % 9 == 8 else "") for i in range(80))


def brute(rows, unit_words=4, run_words=16, anchor=16):
    """The same rule with a dictionary of all units."""
    first = {}
    texts = sorted({(2**63 - 1 if r[0] is None else r[0], r[1]) for r in rows if r[1] is not None}, key=lambda t: t[0])
    for rank, text in texts:
        u = S.Units(text, anchor)
        for d, n in zip(u.digests, u.count):
            if n >= unit_words:
                first[d] = min(first.get(d, rank), rank)
    out = []
    for doc_id, text, *_ in rows:
        if text is None:
            out.append((doc_id, None, 0))
            continue
        u, seen, marked = S.Units(text, anchor), set(), []
        rank = 2**63 - 1 if doc_id is None else doc_id
        for d, n in zip(u.digests, u.count):
            marked.append(n >= unit_words and (first[d] < rank or d in seen))
            seen.add(d)
        gone = sum(sum(u.count[a:b]) for a, b in S.marked_runs(u.count, marked, unit_words, run_words))
        out.append((doc_id, len(text), gone))
    return sorted(out, key=str)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows_as_brute_force(spark, clashes):
    got = S.dedup_passages(documents(spark, clashes=clashes)).collect()
    assert sorted(((r.doc_id, None if r.text is None else r.original_chars, r.removed_words) for r in got), key=str) == brute(ROWS)


def test_real_documents_as_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = S.dedup_passages(df).collect()
    assert sorted(((r.doc_id, r.original_chars, r.removed_words) for r in got), key=str) == brute(rows)
    assert sum(r.removed_words > 0 for r in got) > 5


def test_passage_goes_from_later_documents_and_offsets_fit(spark):
    own = [" ".join(f"{i}é{j}" for j in range(60)) for i in range(4)]
    rows = [(i, f"{own[i]} tail {PASSAGE} and then {own[i][::-1]}", "en", "s", 1) for i in range(4)]
    rows.append((9, "nothing in common here at all " + own[3][::-1].upper()[:50], "en", "s", 1))
    got = {r.doc_id: r for r in S.dedup_passages(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    assert got[0].removed_words == 0 and got[0].text == rows[0][1] and got[9].removed_words == 0
    for i in (1, 2, 3):
        text, at, left = rows[i][1], 0, []
        for span in got[i].removed_spans.split(","):
            a, b = map(int, span.split("-"))
            assert text[a:b] in PASSAGE
            left.append(text[at:a])
            at = b
        assert "".join(left) + text[at:] == got[i].text
        assert got[i].removed_words >= 50


def test_repeat_inside_one_document(spark):
    line = " ".join(f"only{i}" for i in range(30))
    got = S.dedup_passages(spark.createDataFrame([(1, f"{line}\n{line}\nx", "", "", 1)], SCHEMA)).collect()[0]
    assert got.text.split() == [*line.split(), "x"]


def test_stage_keeps_columns_and_clean_documents(spark):
    df = documents(spark, clashes=True)
    left = S.drop_repeats(df)
    assert left.columns == df.columns and [f.dataType for f in left.schema] == [f.dataType for f in df.schema]
    ids = [r.doc_id for r in left.collect()]
    assert {1, 4, 5, 6, 7, 8, 9, 10, 2**53 + 1} <= set(ids) and None in ids


def test_empty_table(spark):
    assert S.dedup_passages(documents(spark, [])).count() == 0


def brute_runs(rows, run_words=16):
    """Words that each row loses, from a dictionary of all windows: what an earlier document holds, and what the text itself held before."""
    words = {(2**63 - 1 if i is None else i, t): t.encode("utf-8", "surrogatepass").lower().split() for i, t, *_ in rows if t is not None}
    holders = {}
    for (rank, text), w in words.items():
        for j in range(len(w) - run_words + 1):
            holders.setdefault(tuple(w[j : j + run_words]), set()).add((rank, S._text_key(text)))
    lost = {}
    for (rank, text), w in words.items():
        gone, seen = set(), {}
        for j in range(len(w) - run_words + 1):
            window = tuple(w[j : j + run_words])
            held = holders[window]
            earlier = min(held)[0] < rank or len({r for r, _ in held}) == 1 and min(held) < (rank, S._text_key(text))
            if earlier or seen.setdefault(window, j) <= j - run_words:
                gone.update(range(j, j + run_words))
        lost[rank, text] = gone
    return lost


def check_runs(rows, got):
    lost = brute_runs(rows)
    want = []
    for i, text, *_ in rows:
        if text is None:
            want.append((i, None, 0))
        else:
            gone = lost[2**63 - 1 if i is None else i, text]
            want.append((i, [w for j, w in enumerate(text.encode("utf-8", "surrogatepass").split()) if j not in gone], len(gone)))
    have = [(r.doc_id, None if r.text is None else r.text.encode("utf-8", "surrogatepass").split(), r.removed_words) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows_lose_exact_runs(spark, clashes):
    check_runs(ROWS, S.dedup_runs(documents(spark, clashes=clashes)).collect())


def test_op9_removes_exact_runs_of_real_documents(spark, sf):
    entry = importlib.import_module("__spark_entry__")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op9_passages"](spark, sf).collect()
    check_runs(rows, got)
    assert sum(r.removed_words > 0 for r in got) > 5


def test_passage_goes_to_its_edges(spark):
    own = [" ".join(f"{i}é{j}" for j in range(60)) for i in range(4)]
    rows = [(i, f"{own[i][: 40 + i]}x {PASSAGE} {own[i]}", "en", "s", 1) for i in range(4)]
    got = {r.doc_id: r for r in S.dedup_runs(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    assert got[0].removed_words == 0 and got[0].text == rows[0][1]
    for i in (1, 2, 3):
        a, b = map(int, got[i].removed_spans.split("-"))
        assert rows[i][1][a:b] == PASSAGE and got[i].removed_words == 80
        assert rows[i][1][:a] + rows[i][1][b:] == got[i].text
    assert {r.doc_id: r.text for r in S.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: r.text for i, r in got.items()}


def test_null_ids_and_equal_ids_keep_one_copy(spark):
    rows = [(None, f"{PASSAGE} own{n}", "", "", 1) for n in range(3)]
    for some in (rows, [(5, *r[1:]) for r in rows]):
        got = S.dedup_runs(spark.createDataFrame(some, SCHEMA)).collect()
        assert sorted(r.removed_words for r in got) == [0, 80, 80]


def test_short_lines_and_one_word_repeated_go_too(spark):
    menu = "\n".join(f"item{i}{' of' * (i % 3)}" for i in range(60))
    rows = [(1, f"first\n{menu}\nend", "", "", 1), (2, f"second {menu} last", "", "", 1), (3, "begin " + "same " * 90, "", "", 1), (4, "again " + "same " * 90 + "other", "", "", 1)]
    got = {r.doc_id: r for r in S.dedup_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].removed_words == 0 and got[2].text.split() == ["second", "last"]
    assert got[3].text.split() == ["begin"] + ["same"] * 16 and got[4].text.split() == ["again", "other"]
