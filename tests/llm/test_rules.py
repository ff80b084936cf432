import random
import re

import pytest

from gridloom.llm.rules import ENDS, RULES, STOP_WORDS, Rule, kept_documents, measured, quality_rules, repeated_words

WORD = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    """Every measure, counted plainly."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_stop_words": sum(w.lower().rstrip(ENDS) in STOP_WORDS for w in words),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_capital_words": sum(any(c.isupper() for c in w) and not any(c.islower() for c in w) for w in words),
        "n_bullet_lines": sum(x.lstrip(" \t\r\x0b\x0c")[0] in "-*•" for x in lines),
        "n_ellipsis_lines": sum(x.rstrip(" \t\r\x0b\x0c").endswith(("...", "…")) for x in lines),
    }


def broken_rules(m):
    out = []
    for r in RULES:
        part, whole = 1000 * m[r.part], 1 if r.whole == "one" else m[r.whole]
        if part < r.least * whole or r.most is not None and whole and part > r.most * whole:
            out.append(r.name)
    return out


def texts():
    rng = random.Random(11)
    words = ("the", "The,", "of", "und", "ÉTÉ", "naïve", "###", "a|b", "12", "-", "*", "...", "Straße", "x" * 12)
    for _ in range(120):
        yield "".join(rng.choice(words[: rng.randint(2, 14)]) + rng.choice((" ", " ", "\n", "\t", "\r\n", "\x0b")) for _ in range(rng.randint(0, 70)))
    some = " ".join(f"w{i}" for i in range(12))
    yield from (some + " " + some, some + "\n" + some + "\n" + some, "a " * 40, " ".join("abcdefgh") * 2, None, "", " \n\t\r", "…", "- a\n* b\n• c", "a b  ")


def test_measures_and_verdicts_equal_plain_counting(docs_of):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "the of"), (3, "again")]
    got = quality_rules(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        m = measures(t)
        bad = broken_rules(m)
        base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        want = {**m, "doc_id": i, "base_failed": base, "failed": ",".join(bad), "kept": not base and not bad}
        assert want in [r.asDict() for r in by[i]], (t, want, by[i])


@pytest.mark.parametrize("text", ["ab " * 200_000, "x" * 1_000_000, "\n" * 300_000, "a-b_" * 250_000, "".join(f"w{i} " for i in range(100_000))])
def test_very_long_texts(docs_of, text):
    (row,) = quality_rules(docs_of([(1, text)])).collect()
    n = len(text.split())
    assert row["n_words"] == n and row["n_repeat_words"] == (n if text.startswith("ab ") else 0)


def test_equal_hashes_alone_do_not_count(spark, monkeypatch):
    """Windows that only look alike are told apart by their words."""
    from pyspark.sql import functions as F

    from gridloom.llm import rules

    monkeypatch.setattr(rules, "_paired", lambda step: lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - step), lambda _: F.lit(1).cast("long")))
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)).split(),), (["a"] * 9,)], "words array<string>")
    assert [r["n"] for r in df.select(repeated_words(F.col("words")).alias("n")).collect()] == [0, 9]


def test_own_columns_are_kept(docs_of):
    good = "It is the end of the day, and we were with them for it. " * 1 + "That was on a hill by the sea, as you know from this."
    docs = docs_of([(1, good), (2, "bad"), (3, None)])
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_rules_are_a_parameter_and_empty_tables_are_fine(docs_of):
    docs = docs_of([(1, "one two"), (2, "one")])
    some = (Rule("pairs", "n_words", "one", least=2_000),)
    assert [(r["doc_id"], r["failed"]) for r in quality_rules(docs, rules=some).orderBy("doc_id").collect()] == [(1, ""), (2, "pairs")]
    assert quality_rules(docs_of([])).collect() == []


def test_no_user_functions(docs_of):
    plan = quality_rules(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "Window" not in plan
    assert len(measured(docs_of([(1, "a")])).columns) > 12
