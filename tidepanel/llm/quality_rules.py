"""Quality rules (operator 2): a ledger of measurements and failure bits, policies over the bits, ablations by bit aggregation.

Every rule is evaluated once per document; the ledger keeps one bit per failed rule beside the measurements. A policy is a mask of
rules under a version; applying one, or asking what a rule alone removes, reads the bits only.

Cases: null or empty text has no words, fails `few_words` and is not kept; rates over zero words count as 0; repeated rows are
measured each; an empty table gives an empty ledger; columns of docs other than the id and text are not read. Lengths are in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import SPACES, WORD, materialise, table

SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also when body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column, width: int) -> Column:
    """Hash of each window of `width` words, by position."""
    n = F.size(words)
    parts = [F.slice(words, i + 1, F.greatest(n - width + 1, F.lit(0))) for i in range(width)]
    zipped = F.arrays_zip(*parts)
    return F.transform(zipped, lambda w: F.xxhash64(*[w[str(i)] for i in range(width)]))


def _covered(hashes: Column, width: int) -> Column:
    """Positions covered by windows whose hash occurs twice or more; sorts (hash, position) only where something repeats."""

    def from_pairs(s: Column) -> Column:
        n = F.size(s)
        pairs = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")))
        return let(F.sort_array(F.array_distinct(F.flatten(pairs))), lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width))), F.lit(0).cast("long"), lambda acc, x: acc + x))

    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(keyed, from_pairs))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The measurements of each document. Built-in functions only; nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    word_chars = F.length(F.translate(text, SPACES, ""))
    step1 = docs.select(F.col(id_col), text.alias("t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return step1.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        F.when(F.size("w") < width, F.lit(0).cast("long")).otherwise(let(_windows(F.col("w"), width), lambda h: _covered(h, width))).alias("n_repeat_words"),
    ).select(id_col, "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Fails a document where `failed` holds; `failed` reads measurements only."""

    name: str
    failed: Column


def standard_rules() -> list[Rule]:
    """Position in the list is the rule's bit. Append only: stored ledgers keep their meaning."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 10),
        Rule("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
        Rule("duplicate_lines", (c("n_lines") >= 5) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        Rule("short_words", c("word_chars") < 2 * c("n_words")),
        Rule("long_words", c("word_chars") > 20 * c("n_words")),
    ]


BASE = ("few_words", "repeated_words")
#: Policy versions: the rules that remove a document.
POLICIES = {"base": BASE, "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words")}


def ledger(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds failed_bits (long): bit i is set if rule i fails. At most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def mask(rules: list[Rule], names: tuple[str, ...]) -> int:
    return sum(1 << i for i, rule in enumerate(rules) if rule.name in names)


def apply_policy(rows: DataFrame, rules: list[Rule], version: str) -> DataFrame:
    """Adds kept and policy; reads failed_bits only."""
    kept = F.col("failed_bits").bitwiseAND(F.lit(mask(rules, POLICIES[version]))) == 0
    return rows.withColumns({"kept": kept, "policy": F.lit(version)})


def ablations(rows: DataFrame, rules: list[Rule], version: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    One aggregation over the distinct masked bit patterns (2^rules at most), then over their few rows.
    """
    names = POLICIES[version]
    patterns = rows.select(F.col("failed_bits").bitwiseAND(F.lit(mask(rules, names))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    bits = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(rules) if r.name in names]
    each = patterns.select("b", "n", F.inline(F.array(*bits)))
    has = F.col("b").bitwiseAND(F.col("bit")) != 0
    alone = F.col("b") == F.col("bit")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(count(has).alias("n_failed"), count(alone).alias("n_failed_alone"), count(F.col("b") == 0).alias("n_kept"), count((F.col("b") == 0) | alone).alias("n_kept_without"))


def stored_ledger(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The ledger of docs, written to the shared folder: policies and ablations read its bits and evaluate no rule again."""
    return materialise(ledger(measurements(docs), rules), "ledger")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = standard_rules()
    return ablations(stored_ledger(table(spark, sf_dir, "documents"), rules), rules, "v1")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = standard_rules()
    rows = apply_policy(stored_ledger(table(spark, sf_dir, "documents"), rules), rules, "v1")
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(rules, BASE))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed_bits")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed_bits = 0 AS kept, n_lines, failed_bits FROM b
"""

ABLATIONS_ORACLE = f"""
WITH q AS ({ORACLE.strip()}), r(rule, bit) AS (VALUES {", ".join(f"('{name}', {1 << i})" for i, name in enumerate(POLICIES["v1"]))})
SELECT rule, CAST(count(*) FILTER (failed_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed_bits = bit) AS BIGINT) AS n_failed_alone,
       CAST(count(*) FILTER (failed_bits = 0) AS BIGINT) AS n_kept, CAST(count(*) FILTER (failed_bits IN (0, bit)) AS BIGINT) AS n_kept_without
FROM q, r GROUP BY rule
"""
