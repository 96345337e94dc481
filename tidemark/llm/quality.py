"""Quality rules: fixed rules on words, lines and symbols, then distance from the language's own profile.

A document's histograms of character classes and of common words are held against those of its language,
which are summed over all documents that pass the fixed rules. Distances are Jensen-Shannon with base 2,
so they lie between 0 and 1. Short documents scatter widely around any profile: below the minimum length
the verdict stays with the fixed rules.

The words that aren't common are one more bin, so a text that lacks a language's common words lies far from it:
about a fifth of a text's words are common, which puts one without any at 0.34. Texts of 50 words of the right
language reach 0.28; the limit of 0.3 lies between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 50, 0.25, 0.3
#: Profiles up to so many languages are broadcast, a few hundred bytes each; beyond, rows and profiles are shuffled.
MAX_PROFILES = 5000
SYMBOLS = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
#: Frequent function words; the profile of a language holds how often each of its own occurs.
COMMON = {
    "en": "the of and to in is that it was for on are with as be by this have or at from not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más".split(),
}
SLOTS = max(map(len, COMMON.values()))
#: Character classes, each what a pattern removes from the text.
CLASSES = {
    "lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": f"{SPACE}+", "stop": r"[.,;:!?'\"()-]+",
    "symbol": r"[\x00-\x08\x0E-\x1F#*$%&|<>+/=@\[\]\\^_`{}~\x7F]+",
}
CHAR_BINS = [*(f"c_{x}" for x in CLASSES), "c_other"]
WORD_BINS = [*(f"w_{i}" for i in range(SLOTS)), "w_other"]


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(w: Column) -> Column:
    """Words that lie in windows of three which occur twice or more, each word once."""
    windows = F.slice(F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))), 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def again(s: Column) -> Column:
        return F.array_sort(F.transform(
            F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]
        ))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bound(_bound(F.sort_array(windows), again), covered))


def _found_words(text: Column, words: list[str]) -> Column:
    """The words of a text that are among some, each between two spaces of its own."""
    found = F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda x: x.isin(words))
    return F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))


def features(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``row``, the kept columns of the document, and counts of its whole text; a null text counts as an empty one."""
    text = F.coalesce("text", F.lit(""))
    tokens = lambda t: F.filter(F.split(t, f"{SPACE}+"), lambda x: x != "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ends = [F.length(F.regexp_replace(text, p, "")) for p in CLASSES.values()]
    n_chars = F.length(text)
    every = F.create_map(*(x for lang, ws in COMMON.items() for x in (F.lit(lang), F.array(*(F.lit(f" {w} ") for w in ws)))))
    own = F.get(F.array(every[F.coalesce("lang", F.lit(""))]), F.lit(0))
    all_common = sorted({w for ws in COMMON.values() for w in ws})

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_common(c: Column) -> Column:
        return F.transform(F.coalesce(own, F.array().cast("array<string>")), lambda x: ((F.length(c) - F.length(F.replace(c, x))) / F.length(x)).cast("long"))

    found = documents.select(
        F.struct(*keep).alias("row"), F.coalesce("lang", F.lit("")).alias("lang"),
        _bound(tokens(text), of_words).alias("of_words"),
        _bound(_found_words(text, all_common), of_common).alias("common"),
        _bound(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        (n_chars - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        n_chars.cast("long").alias("n_chars"),
        *((n_chars - e).cast("long").alias(f"c_{x}") for x, e in zip(CLASSES, ends, strict=True)),
    )
    base = F.when(F.col("n_words") < 50, True).otherwise(100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.select("*", "of_words.*").drop("of_words").withColumns({f"w_{i}": F.coalesce(F.get("common", F.lit(i)), F.lit(0)).cast("long") for i in range(SLOTS)})
    return found.select(
        "row", "lang", "n_words", (F.col("n_chars") - F.col("c_space")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        *CHAR_BINS[:-1], (F.col("n_chars") - sum(F.col(c) for c in CHAR_BINS[:-1])).alias("c_other"),
        *WORD_BINS[:-1], (F.col("n_words") - sum(F.col(c) for c in WORD_BINS[:-1])).alias("w_other"),
    )


def distance(bins: list[str]) -> Column:
    """Jensen-Shannon distance between the bins and the profile's, named r_<bin>; null where either side is empty."""
    mine = lambda prefix: F.array(*(F.col(f"{prefix}{b}").cast("double") for b in bins))
    whole = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def shares(a: Column) -> Column:
        return _bound(whole(a), lambda n: F.transform(a, lambda x: F.try_divide(x, n)))

    def of(p: Column, q: Column) -> Column:
        each = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
        return F.when(p[0].isNotNull() & q[0].isNotNull(), F.sqrt(F.greatest(whole(each) / 2, F.lit(0.0))))

    return _bound(shares(mine("")), lambda p: _bound(shares(mine("r_")), lambda q: of(p, q)))


def _verdicts(documents: DataFrame, keep: list[str], max_char: float, max_word: float, min_words: int) -> DataFrame:
    """``row``, the counts, char_distance, word_distance and kept."""
    counted = written(features(documents, keep), "quality")
    bins = CHAR_BINS + WORD_BINS
    profile = written(counted.where("NOT base_failed").groupBy("lang").agg(*(F.sum(b).alias(f"r_{b}") for b in bins)), "profile")
    if profile.count() <= MAX_PROFILES:
        profile = F.broadcast(profile)
    listed = F.when(F.col("lang").isin(*COMMON), distance(WORD_BINS))
    held = counted.join(profile, "lang", "left").withColumns({"char_distance": distance(CHAR_BINS), "word_distance": listed})
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > max_char) | (F.col("word_distance") > max_word))
    return held.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def judged(documents: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document: the counts, base_failed, kept, char_distance and word_distance.

    Only documents of ``min_words`` words are held against the profiles. A language without a list of common
    words has no word profile, one whose documents all fail the fixed rules has none at all: the fixed rules
    decide. Texts of any length count whole, equal rows get equal verdicts, other columns don't matter.
    """
    found = _verdicts(documents, ["doc_id"], max_char, max_word, min_words)
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def passing(documents: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that ``judged`` keeps, with the columns they had; each row carries its own verdict, none is joined."""
    return _verdicts(documents, documents.columns, max_char, max_word, min_words).where("kept").select("row.*")


def oracle() -> str:
    """The result of ``judged`` with distances rounded to six places, as DuckDB SQL."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    space = SPACE
    chars = [f"length(text) - length(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c_{x}" for x, p in CLASSES.items()]
    own = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {quoted(ws)}" for lang, ws in COMMON.items()) + " END"
    slots = [f"len(list_filter(common, lambda x: x = own[{i + 1}])) AS w_{i}" for i in range(SLOTS)]

    def js(bins: list[str]) -> str:
        p, q = "(" + " + ".join(bins) + ")", "(" + " + ".join(f"r_{b}" for b in bins) + ")"
        term = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ({m})) ELSE 0.0 END"
        each = []
        for b in bins:
            x, y = f"({b}::DOUBLE / {p})", f"(r_{b}::DOUBLE / {q})"
            each += [term(x, f"({x} + {y}) / 2"), term(y, f"({x} + {y}) / 2")]
        return f"CASE WHEN {p} > 0 AND {q} > 0 THEN sqrt(greatest(({' + '.join(each)}) / 2, 0.0)) END"

    common = " + ".join(WORD_BINS[:-1])
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(text, chr(10)) AS ls,
      list_filter(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'), lambda x: list_contains({quoted(sorted({w for ws in COMMON.values() for w in ws}))}, x)) AS common, {own} AS own FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM
      (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM t))),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY rid),
l AS (SELECT rid, len(x) - len(list_distinct(x)) AS n_dup_lines FROM (SELECT rid, list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM t)),
k AS (SELECT t.rid, doc_id, lang, len(ws) AS n_words, length(regexp_replace(text, '{space}+', '', 'g')) AS word_chars, length(text) AS n_chars,
      length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {', '.join(chars)}, {', '.join(slots)}
      FROM t JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_chars - ({' + '.join(CHAR_BINS[:-1])}) AS c_other, n_words - ({common}) AS w_other FROM k),
p AS (SELECT lang, {', '.join(f'sum({b}) AS r_{b}' for b in CHAR_BINS + WORD_BINS)} FROM f WHERE NOT base_failed GROUP BY lang),
h AS (SELECT *, {js(CHAR_BINS)} AS cd, CASE WHEN lang IN ({', '.join(repr(x) for x in COMMON)}) THEN {js(WORD_BINS)} END AS wd FROM f LEFT JOIN p USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_words >= {MIN_WORDS} AND (cd > {MAX_CHAR_DISTANCE} OR wd > {MAX_WORD_DISTANCE}), false) AS kept,
       round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM h
"""
