"""Quality rules by distribution divergence, in DataFrame expressions only.

A text's character classes and common words are counted in its row and compared with its language's reference by Jensen-Shannon
distance (base 2, so from 0 to 1). The references are the same counts summed over all documents of the language. Each test has a
least length, below which a histogram says too little. Texts that fail the base rules are rejected whatever their histograms say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Frequent words of the languages with a word histogram.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "was"],
    "de": ["der", "die", "und", "den", "in", "das", "von", "zu", "ein", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "un"],
}
OTHER = "other"
SPACE = r"[\x20\x09-\x0D]"
CLASSES = ["letters", "wide", "space", "upper", "digit", "punct", "symbol"]
CLASS_LIMIT, CLASS_CHARS = 0.3, 200
WORD_LIMIT, WORD_WORDS = 0.45, 100


def _named(j: int) -> Column:
    """How often the language's common word ``j`` is among ``hits``."""
    return F.size(F.filter("hits", lambda w: w == F.get("common", F.lit(j)))).cast("long")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row, however often later expressions name them.

    A generator of one row is not merged into the projections above it, where every use would repeat the expression.
    """
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(one)))


def measured(docs: DataFrame, base: bool = True) -> DataFrame:
    """``docs`` with the struct ``__q`` of base counts and histograms; only the histograms without ``base``.

    A null text counts as empty; a language without common words here, or none, has the word list of ``other``, which is empty. Other columns stay, whatever
    their names.
    """
    held = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]  # out of the way of the names below
    df = docs.select(*held, F.coalesce("text", F.lit("")).alias("t"), F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise(OTHER).alias("language"), F.col("lang").alias("own"))
    lists = F.coalesce(*[F.when(F.col("language") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()], F.array().cast("array<string>"))
    df = _once(df, words=F.filter(F.split("t", f"{SPACE}+"), lambda w: w != ""), common=lists)
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    df = _once(
        df, n_words=F.size("words").cast("long"), word_chars=F.length(F.array_join("words", "")).cast("long"), n_symbols=count(r"[#*$%&|<>]"),
        chars=F.length("t").cast("long"), bytes=F.octet_length("t").cast("long"), upper=count("[A-Z]"), digit=count("[0-9]"),
        punct=count(r"[.,;:!?'\"()-]"), hits=F.filter("words", lambda w: F.array_contains("common", w)),
    )
    space = F.col("chars") - F.col("word_chars")
    letters = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("punct") - F.col("n_symbols")
    classes = F.array(letters, F.col("bytes") - F.col("chars"), space, F.col("upper"), F.col("digit"), F.col("punct"), F.col("n_symbols"))
    named = F.array(*[_named(j) for j in range(10)])
    rest = F.col("n_words") - F.size("hits")
    fields = [F.col("language"), F.col("own").alias("lang"), F.col("n_words"), F.col("word_chars"), F.col("n_symbols"), F.col("chars"), classes.cast("array<double>").alias("classes"), F.concat(named, F.array(rest)).cast("array<double>").alias("common")]
    if base:
        df = _repeats(df)
        fields += [F.col("n_dup_lines"), F.col("n_repeat_words")]
    own = [f"__c{i}" for i in range(len(docs.columns))]
    measures = _once(df.select(*own, F.struct(*fields).alias("q")), __q=F.col("q"))
    return measures.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)], "__q")


def _repeats(df: DataFrame) -> DataFrame:
    """Lines equal to an earlier one, and words in 8-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Only a row that has a repeated window sorts its windows; the places of the repeated
    ones, in order, give the words they cover.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - 7), lambda i: F.xxhash64(F.slice("words", i, 8)))
    df = _once(df, windows=F.when(F.col("n_words") >= 8, windows).otherwise(F.array().cast("array<long>")), lines=F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    keyed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _once(df, sorted=F.when(F.size(F.array_distinct("windows")) < F.size("windows"), keyed), n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    same = lambda a, i: F.coalesce(F.get("sorted", i)["h"] == a["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    df = _once(df, starts=F.when(F.col("sorted").isNotNull(), starts))
    covered = F.transform("starts", lambda s, i: F.least(F.coalesce(F.get("starts", i + 1) - s, F.lit(8)), F.lit(8)))
    none = F.lit(0).cast("long")
    return _once(df, n_repeat_words=F.coalesce(F.aggregate(covered, none, lambda a, x: a + x), none))


def references(measures: DataFrame) -> DataFrame:
    """Summed histograms of each value of ``lang``, whichever they are; none of null."""
    sums = [F.sum(F.get(F.col(f"__q.{name}"), F.lit(i))).cast("double").alias(f"{name}{i}") for name, n in (("classes", len(CLASSES)), ("common", 11)) for i in range(n)]
    total = measures.where("__q.lang IS NOT NULL").groupBy(F.col("__q.lang").alias("ref_language")).agg(*sums)
    return total.select("ref_language", F.array(*[f"classes{i}" for i in range(len(CLASSES))]).alias("ref_classes"), F.array(*[f"common{i}" for i in range(11)]).alias("ref_common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; 0 where one has no counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda x, y: F.when(x > 0, 0.5 * x * F.log2(2 * x / (x + y))).otherwise(0.0)
    shares = lambda a: F.transform(a, lambda x: x / total(a))
    apart = total(F.zip_with(shares(p), shares(q), lambda x, y: term(x, y) + term(y, x)))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(apart, F.lit(0.0)))).otherwise(0.0)


def judged(measures: DataFrame, refs: DataFrame) -> DataFrame:
    """``measures`` with ``__class_distance``, ``__word_distance``, ``__base_failed`` and ``__kept``. Without a language no text fails the class test."""
    few = F.broadcast(refs)  # a row for each language
    df = measures.join(few, F.col("__q.lang") == F.col("ref_language"), "left")
    q = F.col("__q")
    df = df.withColumn("__class_distance", F.when(q["chars"] >= CLASS_CHARS, distance(q["classes"], F.col("ref_classes"))).otherwise(0.0))
    word = (q["n_words"] >= WORD_WORDS) & (q["language"] != OTHER)
    df = df.withColumn("__word_distance", F.when(word, distance(q["common"], F.col("ref_common"))).otherwise(0.0))
    failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    kept = ~failed & (F.col("__class_distance") <= CLASS_LIMIT) & (F.col("__word_distance") <= WORD_LIMIT)
    return df.withColumn("__base_failed", failed).withColumn("__kept", kept).drop("ref_language", "ref_classes", "ref_common")


def quality_filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    return judged(measured(docs), references(measured(docs, base=False))).where("__kept").select(*[f"`{c}`" for c in docs.columns])
