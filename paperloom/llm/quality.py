"""Rule bitmask ledger for document quality, on DataFrame functions alone.

measure() evaluates every rule once and keeps the measurements beside one long of failure bits; a policy is a
mask over those bits, so a policy change or an ablation reads the ledger and never the texts.

Defined cases: a null text counts as empty; a text without a word has zeros everywhere and fails too_few_words;
repeated rows give repeated ledger rows; any further columns of the input, whatever their names, are left alone
(the ledger has only its own); an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_exclamations")

#: Bit of each rule -> SQL predicate over the measurements; true is a failure.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "many_duplicate_lines": "n_lines > 0 AND 2 * n_dup_lines > n_lines",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "n_words > 0 AND word_chars > 25 * n_words",
    "many_exclamations": "2 * n_exclamations > n_words",
    "no_words_at_all": "n_words = 0",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE_MASK = BITS["too_few_words"] | BITS["repeated_windows"]

#: Policy version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "2024-strict": tuple(RULES),
    "default": ("too_few_words", "repeated_windows", "many_symbols", "many_duplicate_lines", "long_words", "many_exclamations"),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(BITS[n] for n in set(names))


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


WINDOW_HASH = "xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])"


def _repeat_words(df: DataFrame, window_hash: str = WINDOW_HASH) -> DataFrame:
    """Adds n_repeat_words: words that lie in a window of five that occurs again in the same text.

    Window hashes and positions share one long (position in the low bits, as few as the text needs), so one
    sort of longs brings equal windows together; neighbours with equal hashes are compared word by word. The
    sort runs only for texts whose distinct windows are fewer than their windows. A text in which two different
    windows have one hash is sorted by the windows themselves instead, so the count is exact for every hash.
    """
    df = df.withColumn(
        "_windows",
        F.expr(
            "CASE WHEN n_words >= 5 THEN transform(sequence(0, CAST(n_words AS INT) - 5), "
            f"i -> {window_hash}) ELSE CAST(array() AS ARRAY<BIGINT>) END"
        ),
    )
    df = df.withColumn("_bits", F.expr("length(bin(n_words))"))
    df = df.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_windows)) < size(_windows) "
            "THEN sort_array(transform(_windows, (h, i) -> shiftleft(h, _bits) | CAST(i AS BIGINT))) "
            "ELSE CAST(array() AS ARRAY<BIGINT>) END"
        ),
    )
    place = "CAST(_sorted[{0}] & (shiftleft(1L, _bits) - 1L) AS INT)"
    hashed = "shiftright(_sorted[{0}], _bits) = shiftright(_sorted[{1}], _bits)"
    words = f"slice(_words, {place} + 1, 5) = slice(_words, {place.replace('{0}', '{1}')} + 1, 5)"
    df = df.withColumn(
        "_clash",
        F.expr(f"size(_sorted) > 1 AND exists(sequence(1, size(_sorted) - 1), j -> {hashed.format('j', 'j - 1')} AND NOT ({words.format('j', 'j - 1')}))"),
    )
    named = "transform(sequence(0, CAST(n_words AS INT) - 5), i -> named_struct('w', slice(_words, i + 1, 5), 'i', i))"
    df = df.withColumn("_named", F.expr(f"CASE WHEN _clash THEN sort_array({named}) ELSE CAST(array() AS ARRAY<STRUCT<w: ARRAY<STRING>, i: INT>>) END"))
    twice = lambda n, same: f"filter(sequence(0, {n} - 1), j -> (j > 0 AND {same.format('j', 'j - 1')}) OR (j < {n} - 1 AND {same.format('j', 'j + 1')}))"
    df = df.withColumn(
        "_places",
        F.expr(
            f"CASE WHEN _clash THEN sort_array(transform({twice('size(_named)', '_named[{0}].w = _named[{1}].w')}, j -> _named[j].i)) "
            f"WHEN size(_sorted) > 1 THEN sort_array(transform({twice('size(_sorted)', hashed)}, j -> {place.format('j')})) ELSE CAST(array() AS ARRAY<INT>) END"
        ),
    )
    return df.withColumn(
        "n_repeat_words",
        F.expr(
            "CASE WHEN size(_places) = 0 THEN 0L ELSE 5L + "
            "CASE WHEN size(_places) = 1 THEN 0L ELSE aggregate(sequence(1, size(_places) - 1), 0L, "
            "(s, k) -> s + CAST(least(5, _places[k] - _places[k - 1]) AS BIGINT)) END END"
        ),
    )


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ledger: id, measurements and `failures`, one long with a bit for each failed rule."""
    df = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    trimmed = F.trim(F.col("_text"), F.lit(SPACES))
    df = df.withColumn("_trimmed", trimmed)
    df = df.withColumn(
        "_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE_RUN))
    )
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_chars": F.length("_text").cast("long"),
            "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
            "n_symbols": _count_of(F.col("_text"), SYMBOLS),
            "n_exclamations": _count_of(F.col("_text"), "!"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    df = _repeat_words(df)
    bits = None
    for name, rule in RULES.items():
        bit = F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    # Columns that are not deterministic keep Catalyst from pushing a reader's filter below the measurements, which
    # would write each of them out again wherever it is used and take minutes to plan.
    fence = F.monotonically_increasing_id() >= 0
    return df.withColumn("failures", bits.cast("long")).select(id_column, *[F.when(fence, F.col(c)).alias(c) for c in (*MEASURES, "failures")])


def apply_policy(ledger: DataFrame, policy: str | tuple[str, ...] = "default") -> DataFrame:
    """The ledger with base_failed and kept under a policy, which is a version name or a tuple of rules."""
    failed = F.col("failures")
    return ledger.withColumns(
        {
            "base_failed": failed.bitwiseAND(F.lit(BASE_MASK)) != 0,
            "kept": failed.bitwiseAND(F.lit(policy_mask(policy) | BASE_MASK)) == 0,
        }
    )


def ablations(ledger: DataFrame, policy: str | tuple[str, ...] = "default") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, rows kept without it.

    One aggregation over the failure bits; at most 2^rules groups reach its second half.
    """
    mask = policy_mask(policy)
    names = [n for n in RULES if BITS[n] & mask]
    groups = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).alias("bit")) for n in names])
    each = groups.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "default", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with docs' own columns, in one pass and without a join."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_column).alias("_source"))
    ledger = apply_policy(measure(whole, "_row", "_source"), policy)
    return ledger.filter("kept").select("_row.*")
