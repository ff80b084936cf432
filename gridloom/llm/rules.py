"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds the ratio of two measures of a text, in thousandths: ``least * whole <= 1000 * part <= most * whole``.
Products of whole numbers are compared, so no rounding decides. The measures are counts over words, lines and characters:

* words are what stands between ASCII white space; a line counts if it holds a word;
* ``n_repeat_words`` counts the words that lie in an eight-word window which the text holds twice or more. Windows are
  compared by hashes first, and only where two are equal by their words;
* stop words are compared in lower case without the punctuation at their end.

Defined cases: null text is empty (no words: the base rule fails it); null and repeated ids keep their rows; a text
of any length is read whole; other columns are not looked at; an empty table gives an empty result. A rule whose
``whole`` is 0 holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of words, and what counts as a symbol.
SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
ENDS = ".,;:!?"
WINDOW = 8
#: Frequent words of German, English, Spanish and French.
STOP_WORDS = (
    "als am an auf aus bei das dem den der des die ein eine er es für hat ich im in ist mit nach nicht sich sie sind so und von war wie wird zu "
    "a and are as at be by for from he is it of on or that the this to was were which with you "
    "al como con de del el en la las lo los más no para pero por que se su un una y "
    "au avec ce dans du elle est et il je le les mais ne ou par pas plus pour qui sa son sur une"
).split()


@dataclass(frozen=True)
class Rule:
    """``part`` of ``whole`` must lie between least and most thousandths."""

    name: str
    part: str
    whole: str
    least: int = 0
    most: int | None = None


#: The table. Measures are named in ``measured``; ``one`` is 1, for plain counts.
RULES = (
    Rule("words", "n_words", "one", least=20_000),
    Rule("word_length", "word_chars", "n_words", least=3_000, most=10_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop_words", "n_stop_words", "n_words", least=60),
    Rule("letters", "n_letter_words", "n_words", least=700),
    Rule("capitals", "n_capital_words", "n_words", most=300),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=350),
    Rule("repeated_words", "n_repeat_words", "n_words", most=300),
    Rule("bullets", "n_bullet_lines", "n_lines", most=900),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=300),
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _paired(step: int) -> Callable[[Column], Column]:
    """Each hash with the one ``step`` places on."""

    def paired(h: Column) -> Column:
        n = F.size(h) - step
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    return paired


def repeated_words(words: Column) -> Column:
    """Number of words in windows of WINDOW words that stand twice or more; ``words`` is a column, not a long expression."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words from those of half as many
        hashes = let(hashes, _paired(step))
    zero = F.lit(0).cast("long")
    return F.when(F.size(words) <= WINDOW, zero).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(_places_of_repeats(words, h), _covered)))
    )


def _repeats(keyed: Column) -> Column:
    """Of structs (k, i) those whose k stands twice or more, in order."""
    same = lambda s, x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
    return let(F.sort_array(keyed), lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))


def _places_of_repeats(words: Column, hashes: Column) -> Column:
    """Sorted places, from 0, of the windows that stand twice or more: equal hashes first, of those equal words."""
    likely = _repeats(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
    spelled = F.transform(likely, lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, WINDOW), " ").alias("k"), x["i"].alias("i")))
    return F.sort_array(F.transform(_repeats(spelled), lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Number of words in windows that begin at these sorted places."""
    fresh = F.transform(places, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - i, F.lit(WINDOW))))
    return F.aggregate(fresh, F.lit(0).cast("long"), lambda total, n: total + n)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns and the measures of its texts."""
    some = f"[^{SPACE}]"
    rest = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(
        *rest,
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(f"({some}+)"), 1).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(some)).alias("lines"),
    )
    count = lambda of, f: F.size(F.filter(of, f)).cast("long")
    return split.select(
        *rest,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", f"[{SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("words", lambda w: F.rtrim(F.lower(w), F.lit(ENDS)).isin(*STOP_WORDS)).alias("n_stop_words"),
        count("words", lambda w: w.rlike("\\p{L}")).alias("n_letter_words"),
        count("words", lambda w: ~w.rlike("\\p{Ll}") & w.rlike("\\p{Lu}")).alias("n_capital_words"),
        count("lines", lambda x: x.rlike(f"^[{SPACE}]*[-*•]")).alias("n_bullet_lines"),
        count("lines", lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$")).alias("n_ellipsis_lines"),
    )


def broken(rule: Rule) -> Column:
    """Whether a row of measures breaks the rule."""
    part, whole = F.lit(1000) * F.col(rule.part), F.lit(1).cast("long") if rule.whole == "one" else F.col(rule.whole)
    low = part < rule.least * whole
    return low if rule.most is None else low | (part > rule.most * whole) & (whole > 0)


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a row of measures breaks, comma-joined in the table's order, as one expression."""
    return F.concat_ws(",", *[F.when(broken(r), F.lit(r.name)) for r in rules])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, the measures, base_failed, kept, failed) of every row; ``failed`` names the rules it breaks."""
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("*", base.alias("base_failed"), compiled(rules).alias("failed")).select(
        *rows.columns, "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed"
    )


def kept_documents(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs that break no rule, with their own columns."""
    own = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return measured(own).where(compiled(rules) == "").select("row.*")
