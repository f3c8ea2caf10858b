import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinsift.llm import contamination as c
from kinsift.llm.subjects import assign_subjects
from kinsift.llm.titles import compare_words, edits, repair, split_title
from kinsift.llm.tokenize import TOKENIZER, encode_corpus, encode_words, read_merges, _Encoder


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def merges():
    return read_merges()


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_equal_the_library(reference, merges, text):
    assert _Encoder(merges).encode([text]).to_pylist()[0] == reference(text)


def test_corpus_ids(spark, reference):
    texts = [None, "", " ", "hello  world", "aaaaaaaaa " * 50, "<|endoftext|> x", "日本語 👩‍🔬 é", "ab" * 40_000, "hello  world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS doc")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {k: reference(t) if t else [] for k, t in enumerate(texts)}
    assert encode_corpus(df.limit(0)).count() == 0


def test_no_words(merges):
    ids, begins = encode_words([], merges)
    assert len(ids) == 0 and begins.tolist() == [0]
    assert encode_words([b"", b"a"], merges)[1].tolist() == [0, 0, 1]


PASSAGE = "The miller of the valley counted forty copper kettles beneath the old bridge before winter came again. Nobody in the chapel believed the piano tuner, who had swapped a wooden horse for two silver spoons."


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    sentences = [s for s in PASSAGE.split(". ")]
    texts, truth = [], set()
    for n in range(60):
        words = sentences[n % 2].split()
        changes = n % 8
        for at in rng.choice(len(words), changes, False):
            words[at] = "changed"
        if changes <= c.allowed_edits(len(words)):
            truth.add(n)
        texts.append("Other words go first, " + " ".join(words) + ". And more follow.")
    documents = spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (102, "  "), (103, "filler " * 30_000 + PASSAGE.upper().replace(" ", "\n")), (103, PASSAGE)], "doc_id long, text string").selectExpr("*", "5 AS item_id", "'x' AS code")
    items = spark.createDataFrame([(7, PASSAGE), (8, None), (9, ""), (10, "Too short.")], "item_id int, passage string")
    got = sorted((r.doc_id, r.item_id) for r in c.leaked_items(documents, items).collect())
    assert got == sorted([(n, 7) for n in truth] + [(103, 7)])
    # the same in blocks of items
    assert sorted((r.doc_id, r.item_id) for r in c.leaked_items(documents, items, block_chars=50).collect()) == got
    assert c.leaked_items(documents.limit(0), items).count() == 0 and c.leaked_items(documents, items.limit(0)).count() == 0


def test_layout_and_writing_do_not_matter():
    assert c.words("Cla-\n> imed &amp; the ﬁrst mayor’s hаll") == ["claimed", "and", "the", "first", "mayors", "hall"]
    assert c.align(c.masks([1, 2, 3, 4]), 4, [9, 1, 2, 7, 4, 9], 1) and not c.align(c.masks([1, 2, 3, 4]), 4, [9, 1, 7, 8, 4, 9], 1)


def edit_table(sentence, window):
    row = [0] * (len(window) + 1)
    for i, x in enumerate(sentence, 1):
        new = [i]
        for j, y in enumerate(window, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(-1, 4), max_size=90), st.integers(0, 12))
def test_alignment_by_bits_equals_the_table(sentence, window, most):
    assert c.align(c.masks(sentence), len(sentence), window, most) == (edit_table(sentence, window) <= most)


SUBJECT_WORDS = {"law": "court judge statute appeal clause verdict".split(), "sport": "goal referee league sprint medal coach".split(), "biology": "enzyme genome tissue plankton spore cell".split()}


def test_subjects_of_held_out_documents(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for n in range(360):
        mine = list(rng.choice(list(SUBJECT_WORDS), 1 + (n % 5 == 0), False))
        said = [f"The {a} of the {b} was revised by hand." for s in mine for a, b in (rng.choice(SUBJECT_WORDS[s], 2) for _ in range(5))]
        rows.append((n, " ".join(said + ["The field has grown and so has the work on it."] * 3)))
        truth[n] = set(mine)
    documents = spark.createDataFrame([*rows, (1000, None), (1001, " "), (1002, ""), (5, rows[5][1])], "doc_id long, text string").selectExpr("*", "'x' AS subject", "1 AS label")
    listed = spark.createDataFrame([(s, "") for s in SUBJECT_WORDS], "subject string, scope string")
    labels = spark.createDataFrame([(n, f" {s.upper()}") for n in range(120) for s in truth[n]] + [(3, "nothing"), (None, "law"), (9999, "law")], "doc_id long, subject string")
    got = {}
    out = assign_subjects(documents, listed, labels).collect()
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(out) == len(set(out)) and min(got) >= 120 and max(got) < 1000
    hits = sum(len(got.get(n, set()) & truth[n]) for n in range(120, 360))
    assert hits / sum(map(len, got.values())) > 0.9 and hits / sum(len(truth[n]) for n in range(120, 360)) > 0.9
    assert assign_subjects(documents, listed, labels.limit(0)).count() == 0
    assert assign_subjects(documents.limit(0), listed, labels).count() == 0
    assert assign_subjects(documents, listed.limit(0), labels).count() == 0


def test_titles():
    assert repair("ParÃ­sh &amp; <i>x</i>") == "parish and  x "
    assert split_title("On Nets, Part II [pdf]")[:2] == (["on", "nets"], "part2")
    assert split_title("Nets (poster)")[1] == "poster" and split_title("Untitled")[0] == [] and split_title(None)[0] == []
    assert split_title("Deep Lear...")[2]
    assert edits("abcd", "abdc") == 1 and edits("r�gister", "register") == 0 and edits("abc", "xyzabc") == 3
    assert compare_words("robust caching of river gauges".split(), "robust planning of river gauges".split())[0] == "other"
    assert compare_words("rob. caching of river gauges".split(), "robust caching of river gauges".split())[0] == "same"
    assert compare_words("robust caching of riv".split(), "robust caching of river gauges".split())[0] == "cut"
