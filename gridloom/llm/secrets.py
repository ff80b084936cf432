"""Secret scan: base patterns plus a randomness test battery, in DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) are found by pattern. Beyond them every
long run of token characters (with the signs that pad it) that has letters and digits, or
letters of both cases, and is no ordinary word is a candidate. Its encoding is
inferred (hex, base32, base64), its characters become symbol numbers of that
alphabet, and three tests ask whether they look like independent uniform draws:
chi-squared of equal parts of the alphabet (four, eight from 28 characters on, sixteen
from 64 on), Wald-Wolfowitz runs about the alphabet's middle, and lag-1 serial correlation. Each gives a p-value under
"random"; the three are combined by Fisher's method into a score.

Whether a score may pass is decided by false-discovery control by length. Ordinary
words and numbers, also joined by signs, are decoys, scored by the same battery, and so
is a fixed list of ordinary names, so a corpus with few decoys of its own is judged, too. For
each length class, the threshold is the lowest score at which the false passes that
the decoys' passing rate predicts are at most ``alpha`` of all passes, counted over all
documents; longer tokens, on which the tests have more power, earn lower thresholds.
Scores are counted in a fixed number of bins, so what is gathered does not grow with the
corpus. Candidates that overlap a base span give way to it.

Positions are code points, end exclusive. Splitting a text by a pattern and
extracting all its matches walk the same matches, so the lengths of both, summed
alternately, give every match's place.

Defined cases: null text is empty; empty and repeated rows give their own result
rows; a text of any length is scanned whole; spans of equal start are ordered by kind, and
overlapping base spans of unlike kinds all stay; null ids are kept; extra columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stage

#: The base patterns, kind by kind, in the order that kinds sort.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Ordinary tokens, the decoys: words and numbers, also joined by signs. No pattern repeats a group: Java matches those by recursion.
WORD, SIGNS = "^([a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+)$", "[_/+-]+"
#: Words that the fixed decoys are joined of.
ORDINARY = ("account", "backup", "channel", "default", "element", "folder", "group", "handler", "internal", "journal", "kernel", "listener", "message", "network", "option", "project", "request", "session", "timeout", "user", "version", "window")
#: Length classes of the false-discovery control: a token belongs to the last one that it reaches.
CLASSES = (20, 28, 40, 64)
BINS = 64
#: A candidate must also be consistent with randomness itself: p of 0.001 or more.
LAST_BIN = 11
SPANS = "array<struct<start:int,end:int,kind:int>>"


def prefix_sums(lengths: Column, chunk: int = 512) -> Column:
    """Sums of all elements before each, in two levels so that long arrays are not copied over and over."""
    n = F.size(lengths)

    def within(part: Column, base: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(base.alias("sum"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
        )

    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda i: F.slice(lengths, i * chunk + 1, F.lit(chunk)))
    done = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<array<int>>)").alias("out")),
        lambda acc, part: F.struct(
            (acc["sum"] + F.aggregate(part, F.lit(0), lambda a, x: a + x)).alias("sum"),
            F.concat(acc["out"], F.array(within(part, acc["sum"])["out"])).alias("out"),
        ),
    )
    return F.when(n > 0, F.flatten(done["out"])).otherwise(F.expr("cast(array() as array<int>)"))


def found(df: DataFrame, text: Column, pattern: str, name: str, value_group: int = 0) -> DataFrame:
    """df with ``name``: array of (start, end, value, size) of the pattern's matches in order.

    value is the match, size the length of the value group.
    """
    spans_type = "array<struct<start:int,end:int,value:string,size:int>>"
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("__m", m)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), F.length)
    some = F.size("__m") > 0
    df = df.withColumn("__g", F.when(some, gaps)).withColumn("__z", F.when(some, sizes))
    steps = F.transform("__m", lambda x, i: F.element_at("__g", i + 1) + F.length(x))
    df = df.withColumn("__p", F.when(some, prefix_sums(steps)))
    spans = F.transform(
        "__m",
        lambda x, i: F.struct(
            (F.get("__p", i) + F.get("__g", i)).alias("start"),
            (F.get("__p", i) + F.get("__g", i) + F.length(x)).alias("end"),
            x.alias("value"),
            F.get("__z", i).alias("size"),
        ),
    )
    empty = F.expr(f"cast(array() as {spans_type})")
    return df.withColumn(name, F.when(some, spans).otherwise(empty).cast(spans_type)).drop("__m", "__g", "__z", "__p")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``n_assign``, ``n_access``, ``n_hex`` and ``base``, the base spans by start, then kind."""
    for kind, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0)):
        df = found(df, F.col(text), pattern, f"__{kind}", group)
        least, number = F.lit(LEAST[kind]), F.lit(KINDS.index(kind)).alias("kind")
        kept = F.filter(f"__{kind}", lambda s: s["size"] >= least)  # noqa: B023  called at once
        df = df.withColumn(f"__{kind}", F.transform(kept, lambda s: F.struct(s["start"], s["end"], number)).cast(SPANS))  # noqa: B023
        df = df.withColumn(f"n_{kind}", F.size(f"__{kind}").cast("long"))
    return df.withColumn("base", by_place(F.concat("__assign", "__access", "__hex"))).drop("__assign", "__access", "__hex")


def by_place(spans: Column) -> Column:
    """Spans by start, then kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def digest_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _survival(z: Column) -> Column:
    """Upper tail of the standard normal (logistic approximation, within 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-500.0)), F.lit(500.0))))


def _two_sided(z: Column) -> Column:
    return F.least(2 * _survival(F.abs(z)), F.lit(1.0))


def encoding(token: Column) -> Column:
    """Inferred alphabet: its characters in symbol order."""
    return (
        F.when(token.rlike("^[0-9a-fA-F]+$"), F.lit("0123456789abcdef"))
        .when(token.rlike("^[A-Z2-7]+$"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        .when(token.rlike("^[0-9a-z_-]+$"), F.lit("0123456789abcdefghijklmnopqrstuvwxyz_-"))
        .when(token.rlike("^[0-9A-Z_-]+$"), F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_-"))
        .otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    )


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(xs: Column, of=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x).cast("double"))


def chi_squared(symbols: Column, n: Column, k: Column) -> Column:
    """p-value of equal use of the alphabet's parts (Wilson-Hilferty)."""
    parts = F.when(n >= 64, F.least(k, F.lit(16))).when(n >= 28, 8).otherwise(4).cast("int")

    def term(count: Column, q: Column, m: Column) -> Column:
        share = (F.ceil(k * (q + 1) / m) - F.ceil(k * q / m)) / k * n
        return (count - share) * (count - share) / share

    def tail(m: Column) -> Column:
        cells = F.transform(symbols, lambda s: F.floor(s * m / k).cast("int"))
        numbers = F.sequence(F.lit(0), m - 1)
        chi = let(cells, lambda c: _sum(F.transform(numbers, lambda q: term(F.size(F.filter(c, lambda x: x == q)).cast("double"), q, m))))
        free = (m - 1).cast("double")
        return _survival((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))

    return let(parts, tail)


def runs(symbols: Column, n: Column, k: Column) -> Column:
    """p-value of the number of runs above and below the alphabet's middle (Wald-Wolfowitz)."""
    sides = F.transform(symbols, lambda s: (s * 2 >= k).cast("int"))

    def p(u: Column) -> Column:
        return let(_sum(u), lambda n1: let(2 * n1 * (n - n1), lambda both: tail(u, both)))

    def tail(u: Column, both: Column) -> Column:
        flips = F.size(F.filter(F.zip_with(F.slice(u, 1, F.size(u) - 1), F.slice(u, 2, F.size(u) - 1), lambda a, b: a != b), lambda x: x))
        var = both * (both - n) / (n * n * (n - 1))
        return F.when(var > 0, _two_sided((flips + 1 - both / n - 1) / F.sqrt(F.when(var > 0, var)))).otherwise(F.lit(1e-12))

    return let(sides, p)


def serial(symbols: Column, n: Column) -> Column:
    """p-value of the correlation of each symbol number with the next."""

    def tail(d: Column) -> Column:
        lagged = _sum(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: a * b))
        square = _sum(d, lambda x: x * x)
        return let(square, lambda sq: F.when(sq > 0, _two_sided((lagged / F.when(sq > 0, sq) + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-12)))

    return let(_sum(symbols) / n, lambda mean: let(F.transform(symbols, lambda s: s - mean), tail))


def battery(given: Column) -> Column:
    """Fisher's combined log10 p-value of the three tests: 0 is most random."""

    def score(alphabet: Column) -> Column:
        token = F.rtrim(given, F.lit("="))
        folded = F.when(F.length(alphabet) == 16, F.lower(token)).when(F.length(alphabet) == 64, F.translate(token, "-_", "+/")).otherwise(token)
        symbols = F.transform(F.regexp_extract_all(folded, F.lit("."), F.lit(0)), lambda c: F.call_function("instr", alphabet, c) - 1)
        return let(symbols, lambda s: let(F.size(s).cast("double"), lambda n: fisher(s, n, F.length(alphabet).cast("double"))))

    def fisher(s: Column, n: Column, k: Column) -> Column:
        half = sum(-F.ln(F.greatest(p, F.lit(1e-30))) for p in (chi_squared(s, n, k), runs(s, n, k), serial(s, n)))
        # -2 sum ln p is chi-squared with six degrees of freedom, whose tail is closed
        return let(half, lambda h: (F.ln(1 + h + h * h / 2) - h) / F.ln(F.lit(10.0)))

    return let(encoding(F.rtrim(given, F.lit("="))), score)


def length_class(size: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(size >= least, i).otherwise(out)
    return out


def score_bin(score: Column) -> Column:
    """Bin of a score: 0 the most random, a quarter of a power of ten each."""
    return F.least(F.floor(F.greatest(-score, F.lit(0.0)) * 4), F.lit(BINS - 1)).cast("int")


def ordinary(token: Column) -> Column:
    """Whether a token is words and numbers joined by signs, which neither begin nor end it."""
    return F.forall(F.split(token, SIGNS, -1), lambda part: part.rlike(WORD))


def judged(token: Column) -> list[Column]:
    """Whether a token is a decoy, its alphabet's size, its length class and its score's bin."""
    return [
        ordinary(token).alias("decoy"),
        F.length(encoding(F.rtrim(token, F.lit("=")))).alias("symbols"),
        length_class(F.length(token)).alias("class"),
        score_bin(battery(token)).alias("bin"),
    ]


def ordinary_names() -> list[str]:
    """The fixed decoys: words of the list, joined by each sign or none, in each case, of every length class."""
    n, out = len(ORDINARY), []
    for i in range(n):
        for sign in "-_/":
            for words in (3, 4, 6, 9):
                for step in (1, 3, 5):
                    parts = [ORDINARY[(i + k * step) % n] for k in range(words)]
                    number = [str(2000 + i)] if i % 2 else []
                    out += [sign.join(parts + number), sign.join([p.capitalize() for p in parts] + number), sign.join([p.upper() for p in parts] + number), "".join(parts), "".join(parts).upper()]
    return sorted({x for x in out if len(x) >= CLASSES[0]})


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base columns and ``tokens``, the scored candidates that lie on no base span."""
    df = found(base_spans(df, text), F.col(text), CANDIDATE, "__c")
    free = F.filter("__c", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    two_kinds = lambda c: c["value"].rlike("[A-Za-z]") & (c["value"].rlike("[0-9]") | (c["value"].rlike("[a-z]") & c["value"].rlike("[A-Z]")))
    tokens = F.transform(F.filter(free, lambda c: two_kinds(c) | ordinary(c["value"])), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), *judged(c["value"])))
    return df.withColumn("tokens", tokens).drop("__c")


def thresholds(rows: DataFrame, alpha: float = 0.05) -> dict[tuple[int, int], int]:
    """(length class, alphabet size) -> last bin that may pass, from counts over all rows.

    A class and alphabet is held against its own decoys, or if they are few against those of
    all alphabets, or of shorter classes, too, which pass more easily. At most
    classes x alphabets x bins counts reach the driver.
    """
    names = F.explode(F.array(*[F.lit(x) for x in ordinary_names()])).alias("name")
    fixed = rows.sparkSession.range(1).select(names).select(*judged(F.col("name")))
    each = rows.select(F.explode("tokens").alias("t")).select("t.decoy", "t.symbols", "t.class", "t.bin").unionByName(fixed)
    counted = each.groupBy("class", "symbols", "bin").agg(F.sum(F.col("decoy").cast("long")).alias("decoys"), F.count("*").alias("all")).collect()

    def decoys(cls: int, shorter: bool, symbols: int | None, last: int) -> int:
        return sum(r["decoys"] for r in counted if (r["class"] == cls or (shorter and r["class"] < cls)) and symbols in (None, r["symbols"]) and r["bin"] <= last)

    out: dict[tuple[int, int], int] = {}
    for cls, symbols in {(r["class"], r["symbols"]) for r in counted}:
        pool = next((p for p in ((False, symbols), (False, None)) if decoys(cls, *p, BINS) * alpha >= 1), (True, None))
        known = decoys(cls, *pool, BINS)
        mine = [(r["bin"], r["all"] - r["decoys"]) for r in counted if (r["class"], r["symbols"]) == (cls, symbols)]
        targets = sum(n for _, n in mine)
        for last in range(LAST_BIN + 1):
            passing = sum(n for b, n in mine if b <= last)
            if passing and targets * (decoys(cls, *pool, last) + 1) / (known + 1) <= alpha * passing:
                out[cls, symbols] = last
    return out


def all_spans(rows: DataFrame, limits: dict[tuple[int, int], int]) -> DataFrame:
    """rows with ``spans``: base spans and the candidates that pass, by start, then kind."""
    passes = lambda t: F.lit(False)
    for (cls, symbols), last in sorted(limits.items()):
        passes = lambda t, f=passes, c=cls, s=symbols, b=last: f(t) | ((t["class"] == c) & (t["symbols"] == s) & (t["bin"] <= b))
    more = F.transform(F.filter("tokens", lambda t: ~t["decoy"] & passes(t)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind")))
    return rows.withColumn("spans", by_place(F.concat("base", more.cast(SPANS))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.05, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans[, text]) of every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scanned(own)
    rows = stage(rows if keep_text else rows.drop("text"), "secret-scan")
    return all_spans(rows, thresholds(rows, alpha)).drop("tokens")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones together, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        gap = gap.when((s["start"] == acc["at"]) & (F.size(acc["out"]) == 0), F.array(F.lit(mark))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text)))))
