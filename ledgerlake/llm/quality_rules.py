"""Quality rules with DataFrame functions alone: base counts of each text, and its distance from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialise

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Common words whose shares make up the word histogram (fixed values: frequent function words of four languages).
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "ein",
    "le", "la", "les", "et", "des", "un", "une", "que", "est", "pour",
    "el", "de", "los", "del", "las", "en", "por", "con", "para", "no",
)
LONGEST = max(len(w.encode()) for w in COMMON_WORDS)
#: Runs of characters of each class: lower case, upper case, other letters and marks, digits, punctuation, symbols. The classes
#: do not overlap; blanks and controls are in none.
PATTERNS = (r"\p{Ll}+", r"\p{Lu}+", r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]+", r"\p{N}+", r"[\p{P}&&[^#*%&]]+", r"[\p{S}#*%&]+")
#: Texts under so many characters (word histogram: words) are not judged by that histogram.
MIN_CHARS, MIN_WORDS = 200, 150
#: Jensen-Shannon distances (0 to 1) from its language's reference beyond which a text is unlike the language.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.24


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def repeat_words(words: Column) -> Column:
    """Words inside a window of WINDOW words that occurs twice or more in the text; ``words`` are 64-bit hashes of the words.

    Windows are compared by a 64-bit hash. Where all differ, that is all; else the windows are sorted with their places, those
    equal to a neighbour are kept, and each adds the words up to the next one's start, WINDOW at most.
    """
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))

    def covered(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        beside = lambda s, x, i: F.coalesce(x.h == F.get(s, i).h, F.lit(False))
        equal = let(at, lambda s: F.filter(s, lambda x, i: beside(s, x, i - 1) | beside(s, x, i + 1)))
        places = F.array_sort(F.transform(equal, lambda x: x.i))
        gaps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(last < 1, F.lit(0).cast("long")).otherwise(found)


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Base counts and histograms of each text, from one scan.

    Lower-case letters are most of a text: they go first, then the blanks, so that the other classes are counted in the little
    that remains. Common words are looked for among words of their length alone.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    split = base.select("doc_id", "lang", "text", words_of(text).alias("words"), F.regexp_replace(text, PATTERNS[0], "").alias("rest"))
    split = split.select("*", F.translate("rest", BLANKS, "").alias("few"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    words, few = F.col("words"), F.col("few")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    short = F.filter(words, lambda w: (F.octet_length(w) <= LONGEST) & F.lower(w).isin(*COMMON_WORDS))
    size = F.length(text) - F.length("rest")
    return split.select(
        "doc_id", "lang",
        F.size(words).cast("long").alias("n_words"),
        (size + F.length(few)).cast("long").alias("word_chars"),
        (F.length(few) - F.length(F.translate(few, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("hashes")).alias("n_repeat_words"),
        F.array(size, *(F.length(few) - F.length(F.regexp_replace(few, p, "")) for p in PATTERNS[1:])).cast("array<long>").alias("chars"),
        let(
            F.transform(short, lambda w: F.lower(w)),
            lambda c: F.concat(F.transform(F.array(*map(F.lit, COMMON_WORDS)), lambda w: F.size(c) - F.size(F.array_remove(c, w))), F.array(F.size(words) - F.size(c))),
        ).cast("array<long>").alias("common"),
    )


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) between the shares of two arrays of counts; null if either is empty."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.struct(total(counts).alias("n"), total(reference).alias("r"))

    def root(b: Column) -> Column:
        shares = F.zip_with(counts, reference, lambda c, y: F.struct((c / b.n).alias("p"), (y / b.r).alias("q")))
        terms = F.transform(shares, lambda x: part(x.p, (x.p + x.q) / 2) + part(x.q, (x.p + x.q) / 2))
        divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
        return F.when((b.n > 0) & (b.r > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))

    return let(both, root)


def references(found: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common, _rows): the summed histograms of each language's texts that pass the base rules."""
    sums = lambda c, n: F.array(*(F.sum(F.when(~base_failed(), F.get(c, F.lit(i))).otherwise(F.lit(0))) for i in range(n)))
    return found.groupBy("lang").agg(sums("chars", len(PATTERNS)).alias("ref_chars"), sums("common", len(COMMON_WORDS) + 1).alias("ref_common"), F.count("*").alias("_rows"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance).

    A text fails the base rules with fewer than 10 words or over 20 % of its words in repeated windows. The reference of a
    language, of each value of ``lang`` (null and empty are one), is the sum of the histograms of its texts that pass them. A text
    is kept if its distance to its language's reference is within the limit, for each histogram that it is long enough for. The
    word histogram has a place for each common word and one for all other words. Null and empty texts have no words and fail.
    Repeated rows give repeated results and add to the references each. An empty table gives an empty result; other columns of any
    name do not matter. Only DataFrame functions run; the scan's small result is written once to the shared folder.
    """
    found = materialise(features(docs, id_col, text_col, lang_col), "quality")
    table = materialise(references(found), "references")
    size = table.agg(F.sum("_rows")).first()[0] or 0
    judged = join_skewed(found, table, "lang", size).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        F.when(total(F.col("chars")) >= MIN_CHARS, distance(F.col("chars"), F.col("ref_chars"))).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_WORDS, distance(F.col("common"), F.col("ref_common"))).alias("word_distance"),
    )
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE)
    out = judged.select("*", (~F.col("base_failed") & ~far).alias("kept"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
