"""Quality rules by distribution divergence, in built-in column functions only.

Base counts of every whole text (words, symbols, repeated lines, repeated 8-word windows) decide
the plain failures.  Two histograms decide the rest: code points by character class, and words by
common word of each language (as written: a text in capitals has none).  The histograms of all documents that pass the base rules are summed
by language into references, and a document fails where its Jensen-Shannon distance to the nearest
reference is too large.  Both distances have a minimum length below which they are not asked: a
short text's histogram says little.

Most words of any text are no common words, so a text without a single one is not far from the
references in absolute terms.  The limit for texts with fewer common words than any reference is
therefore a share of the distance that a histogram without common words has to the nearest one.
It is not asked of a text whose language is named and has no reference.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.common import SPACE, let, placed, staged, text_of, without

# Frequent words of each language, in natural order.
COMMON = {
    "de": "auf das dem den der des die ein eine es für im in ist mit sich und von war zu",
    "en": "a and are as at be by for from in is it of on that the this to was with",
    "es": "a con de del el en es la las lo los no para por que se su un una y",
    "fr": "à au dans de des du en est et il la le les par pour que qui sur un une",
}
# Character classes of the code points inside words; the last class is "any other".
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{N}", r".,;:!?", r"#*$%&|<>"]
SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_char_distance: float = 0.3
    min_chars: int = 200
    max_word_distance: float = 0.37
    max_bare_share: float = 0.925
    min_distance_words: int = 60


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON.values() for w in words.split()})


def _repeats(words: Column, window: int) -> Column:
    """Words that lie in a window found at least twice, by sorted window hashes."""
    def covered(hashes: Column) -> Column:
        def by_place(pairs: Column) -> Column:
            same = lambda i, j: pairs[i]["h"] == pairs[j]["h"]
            found = F.filter(pairs, lambda p, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i))
                             | ((i < F.size(pairs) - 1) & same(i, F.least(i + 1, F.size(pairs) - 1))))
            return let(F.sort_array(F.transform(found, lambda p: p["at"])), lambda at: F.aggregate(
                at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda acc, p: F.struct((p + window).alias("end"), (acc["n"] + F.least(F.lit(window), p + window - acc["end"])).alias("n")),
                lambda acc: acc["n"]))
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, by_place))
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(
        let(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window))), covered))


def _classes(text: Column, letters: Column) -> list[Column]:
    counts = [F.length(F.regexp_replace(text, f"[^{c}]+", "")) for c in CLASSES]
    return counts + [letters - sum(counts[1:], counts[0])]


def measured(docs: DataFrame, rules: Rules = Rules(), *more: str) -> DataFrame:
    """``doc_id``, ``lang``, the base counts and both histograms of every whole text; null text has no words."""
    vocab = vocabulary()

    def counts(words: Column) -> Column:
        flat = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(flat).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(flat, SYMBOLS, "")).cast("long").alias("n_symbols"),
            _repeats(words, rules.window).cast("long").alias("n_repeat_words"),
            let(flat, lambda text: F.array(*[c.cast("long") for c in _classes(text, F.length(text))])).alias("chars"),
            let(F.filter(words, lambda w: w.isin(vocab)), lambda common: F.array(
                *[(F.size(common) - F.size(F.array_remove(common, w))).cast("long") for w in vocab],
                (F.size(words) - F.size(common)).cast("long"))).alias("common"))

    text = text_of()
    bare = F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", "lang", *more, let(words, counts).alias("m"),
                       let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))
    few = F.col("n_words") < rules.min_words
    repeats = 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    return rows.select("doc_id", "lang", *more, "m.*", "n_dup_lines").withColumn("base_failed", few | repeats)


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of character classes and common words by language, over every row that passes the base rules."""
    width = len(CLASSES) + 1
    sums = (rows.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON)))
            .select("lang", F.posexplode(F.concat("chars", "common")).alias("at", "n"))
            .groupBy("lang", "at").agg(F.sum("n").alias("n")).collect())
    out = {}
    for lang in sorted({r["lang"] for r in sums}):
        counts = {r["at"]: r["n"] for r in sums if r["lang"] == lang}
        both = [counts[i] for i in range(len(counts))]
        parts = both[:width], both[width:]
        out[lang] = tuple([c / max(1, sum(part)) for c in part] for part in parts)
    return out


def distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram to fixed shares."""
    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    both = let(total, lambda n: F.zip_with(counts, F.array(*[F.lit(s) for s in shares]), lambda c, q: let(
        c / n, lambda p: let((p + q) / 2, lambda m: (term(p, m) + term(q, m)) / 2))))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))


def bare_distance(shares: list[float]) -> float:
    """The distance to fixed shares of a histogram that holds nothing but its last entry."""
    p = [0.0] * (len(shares) - 1) + [1.0]
    terms = [x * math.log2(2 * x / (x + y)) for a, b in zip(p, shares) for x, y in ((a, b), (b, a)) if x > 0]
    return math.sqrt(max(0.0, sum(terms) / 2))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: the base counts, both distances, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules.  Without a reference (no passing
    row in a listed language) distances are null and do not reject.  Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    rows = staged(measured(docs, rules), "measured")
    return judged(rows, references(rows), rules).drop("lang", "chars", "common")


def judged(rows: DataFrame, known: dict, rules: Rules) -> DataFrame:
    """Measured rows with their distances to the references and the verdict."""
    def nearest(column: str, part: int) -> Column:
        found = [distance(F.col(column), ref[part]) for ref in known.values()]
        return F.array_min(F.array(*found)) if found else F.lit(None).cast("double")
    out = rows.withColumn("char_distance", F.when(F.col("word_chars") > 0, nearest("chars", 0)))
    out = out.withColumn("word_distance", F.when(F.col("n_words") > 0, nearest("common", 1)))
    bare = F.lit(False)
    if known:
        limit = rules.max_bare_share * min(bare_distance(ref[1]) for ref in known.values())
        fewer = F.get("common", F.size("common") - 1) > max(ref[1][-1] for ref in known.values()) * F.col("n_words")
        bare = (F.col("lang").isNull() | F.col("lang").isin(list(known))) & fewer & (F.col("word_distance") > limit)
    odd = ((F.col("word_chars") >= rules.min_chars) & (F.col("char_distance") > rules.max_char_distance)) | (
        (F.col("n_words") >= rules.min_distance_words) & ((F.col("word_distance") > rules.max_word_distance) | bare))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                              "char_distance", "word_distance")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The input rows that are kept, with all their columns, whatever these are called."""
    rows, key = placed(docs)
    found = staged(measured(rows, rules, key), "measured")
    return without(rows, judged(found, references(found), rules).where(~F.col("kept")).select(key), key)
