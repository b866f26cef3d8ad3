"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once. The ledger keeps the measurements and one ``fail_bits`` number per document;
policies are versioned masks over it, applied later without touching the texts again, and ablations
(what each rule rejects, and what it alone rejects) are counts over the few distinct masks.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated words are those in windows of three words that occur twice or
more in the text. Windows are told apart by 64-bit hashes of their words within one text.

Cases: a null or empty text has no words and fails ``few_words``; repeated rows are judged each; null
doc_ids pass through; columns of other names are not read, and measured columns replace input columns of
the same name; an empty table gives an empty ledger and ablations of zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = list("#*$%&|<>")

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]



def rules() -> dict[str, Column]:
    """Rules in the order of their bits: true where a document fails. Shares are compared in whole numbers."""
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * n,
        "many_symbols": 100 * c("n_symbols") > 20 * n,
        "duplicate_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "short_words": 10 * c("word_chars") < 20 * n,
        "long_words": c("word_chars") > 30 * n,
    }


BASE_RULES = ["few_words", "repeated_words"]

#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BASE_RULES,
    "v1": ["few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words"],
}


def mask(names: list[str]) -> int:
    order = list(rules())
    return sum(1 << order.index(n) for n in names)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements as long columns. One narrow pass."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    drop = [c for c in ("__text", "__words", "__lines", "__windows", "__places", "__starts", *MEASURES) if c in docs.columns]
    df = docs.drop(*drop).withColumn("__text", text)
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), SYMBOLS, F.col("__text"))
    df = df.withColumns({
        "__words": F.array_remove(F.split("__text", "[\\x20\\x09-\\x0D]+"), ""),
        "__lines": F.filter(F.split("__text", "\n", -1), lambda x: F.rtrim(x, F.lit(BLANKS)) != ""),
        "n_symbols": (F.length("__text") - F.length(plain)).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": F.when(F.size("__words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("__words", 1, F.size("__words") - 2), lambda x, i: F.xxhash64(x, F.get("__words", i + 1), F.get("__words", i + 2)))),
    })
    # windows sorted by hash and place; those equal to a neighbour occur twice or more
    places = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("__places", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), places))
    twice = lambda e, i: (e["h"] == F.get("__places", i - 1)["h"]) | (e["h"] == F.get("__places", i + 1)["h"])
    starts = F.sort_array(F.array_compact(F.transform("__places", lambda e, i: F.when(twice(e, i), e["p"]))))
    df = df.withColumn("__starts", starts)
    steps = F.transform("__starts", lambda p, i: F.coalesce(F.least(F.get("__starts", i + 1) - p, F.lit(3)), F.lit(3)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return df.drop("__text", "__words", "__lines", "__windows", "__places", "__starts")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the measurements and ``fail_bits``."""
    df = measure(docs, text_col).drop(text_col)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(r, F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules().values())])
    return df.withColumn("fail_bits", bits.cast("long"))


def keeps(policy: str = "v1") -> Column:
    """Whether a policy keeps a ledger's row."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(r, F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules().values())])
    held = docs.select(F.struct("*").alias("__row"), F.col(f"`{text_col}`").alias("__own"))
    # a row number beside the bits keeps the filter above them: pushed below, it would repeat every measurement
    judged = measure(held, "__own").select("__row", bits.cast("long").alias("fail_bits"), F.monotonically_increasing_id().alias("__place"))
    return judged.where(keeps(policy) & (F.col("__place") >= 0)).select("__row.*")


def ablations(judged: DataFrame, policy: str = "v1") -> DataFrame:
    """``rule, failed, failed_alone``: documents that each rule of a policy rejects, and rejects alone.

    One aggregation to the distinct masks (2 ** rules at most), then bitwise conditions on those.
    """
    active = mask(POLICIES[policy])
    masks = judged.groupBy(F.col("fail_bits").bitwiseAND(F.lit(active)).alias("m")).agg(F.count("*").alias("n"))
    order = list(rules())
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    row = masks.agg(F.array(*(F.struct(F.lit(r).alias("rule"), total(F.col("m").bitwiseAND(F.lit(1 << order.index(r))) != 0).alias("failed"), total(F.col("m") == 1 << order.index(r)).alias("failed_alone")) for r in POLICIES[policy])).alias("rows"))
    return row.select(F.inline("rows"))
