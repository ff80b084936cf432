import numpy as np

from gridloom.llm import toxicity as t


def test_folding():
    assert t.fold("You 1D10T!!") == " you idiot " and t.fold("IDIOT") == t.fold("idіot") == t.fold("Ｉｄｉｏｔ") == " idiot "
    assert t.fold("a-b_c\nd") == " a b c d " and t.fold("scum!") == t.fold("$cum") == " scum " and t.fold("l0ser") == t.fold("LOSER") == " ioser "
    assert t.fold(None) == t.fold("") == " "


def test_disguises():
    for text in ("i.d.i.o.t", "i d i o t", "i-d-i-o-t", "i_d_i_o_t", "id\u200biot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "iiidiooot", "1d!0t", "I\u00adDIOT"):
        assert t.fold(f"you {text}, go") == " you idiot go ", text
    assert t.fold("e.g. a b c") == " e g a b c " and t.fold("x-ray") == " x ray "


def test_exceptions_in_long_texts_take_linear_time():
    import time

    lexicon = t.Lexicon({t.fold("scum"): 3.0})
    start = time.perf_counter()
    assert lexicon.features("pond scum " * 100_000) == (0, 0, 0)
    assert lexicon.features("pond scum " * 100_000 + "you scum")[1] == __import__("pytest").approx(np.log1p(3.0))
    assert time.perf_counter() - start < 30


def naive(lexicon, text):
    folded, best = t.fold(text), {}
    cover = [(i, i + len(p)) for p in map(t.fold, lexicon.exceptions) for i in range(len(folded)) if folded.startswith(p, i)]
    for entry, w in lexicon.weights.items():
        for i in range(len(folded)):
            if folded.startswith(entry, i) and not any(a <= i and i + len(entry) <= b for a, b in cover):
                if i not in best or abs(w) > abs(best[i]):
                    best[i] = w
    return max(0.0, sum(best.values()))


def test_matches_against_naive_search():
    lexicon = t.Lexicon({" idiot ": 3.0, " idi": 1.5, " scum ": 2.0, " ver": 0.5})
    for text in ("an idiot and an idiotic verse", "idiot idiot scum", "pond scum is no scum", "", None, "nothing"):
        assert np.expm1(lexicon.features(text)[1]) == __import__("pytest").approx(naive(lexicon, text), abs=1e-9)


def test_exceptions_and_length():
    lexicon = t.Lexicon({" scum ": 3.0})
    assert lexicon.features("pond scum") == (0, 0, 0) and lexicon.features("you scum")[0] > 0
    assert lexicon.features("scum")[0] > lexicon.features("scum " + "fine words here " * 400)[0]


def test_defined_cases(docs_of, labels_of):
    calm = "the river runs past old houses and a quiet mill "
    rows = [(i, calm * (1 + i % 3)) for i in range(60)] + [(100 + i, calm + f"you gr0bnik number {i} ") for i in range(30)] + [(None, None), (500, ""), (501, calm * 3000), (3, calm)]
    labels = labels_of([(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(30)] + [(None, 1, 1), (9, None, None), (10, 1, 0)])
    got = t.toxicity_scores(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] is not None and 100 <= r["doc_id"] < 130) for r in got)
    bare = t.toxicity_scores(docs_of([(1, "you idiot, scum, moron"), (2, calm)]), labels_of([])).collect()
    assert {r["doc_id"]: r["predicted"] for r in bare} == {1: 1, 2: 0}
    assert t.toxicity_scores(docs_of([]), labels).count() == 0
    small = t.toxicity_scores(docs_of(rows), labels, sample=50).collect()
    assert len(small) == len(rows)


def test_repeated_ids_teach_once(docs_of, labels_of):
    from gridloom.llm.toxicity import labelled_sample

    docs = docs_of([(1, "b text")] * 50 + [(1, "a text"), (2, None)])
    got = labelled_sample(docs, labels_of([(1, 1, 1), (2, 1, 0), (3, 1, 0)]), "toxic", 10).collect()
    assert sorted((r["folded"], r["label"]) for r in got if r["label"]) == [(" a text ", 1)] and len(got) == 2
