"""Operator 8: a ledger of quality rules as bit masks.

One pass over whole texts measures every document and evaluates every rule once; the ledger row holds the measurements
and one failure bit a rule. A policy is a versioned mask over these bits, applied without touching texts again, and
an ablation is a count over the ledger's masks (at most 2**rules distinct ones) with a bit taken out.

Defined results: null and empty texts have no words and fail `few_words`; all-numeric measurements of them are 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb

#: Rule -> condition of failure on the measurements, in exact integer arithmetic. The order gives the bits.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",  # a header that closes a short text is no junk
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
    "capitals": "100 * n_upper > 50 * n_ascii_letters",
    "exclamations": "10 * n_exclaim > n_words",
    "not_alphabetic": "100 * n_alpha_words < 60 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policy versions. v1 is the base alone.
POLICIES = {"v1": BASE, "v2": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_ascii_letters", "n_exclaim", "n_alpha_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _LOWER, _ALPHA = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LOWER[97:123] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Count of set flags in each span at[i]..at[i+1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _seen_before(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it stand earlier; does it stand twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return earlier, shared


def measure(b: tb.Block) -> dict[str, np.ndarray]:
    data, at = b.data, b.at
    start, end, word_at = tb.words(b, tb.SPACED)
    n_words = np.diff(word_at)
    sums = tb.prefix(data, False)
    doc_of_word = np.repeat(np.arange(b.n, dtype=np.uint64), n_words)
    # three-word windows found twice or more in their document
    gram = tb.gram_hash(tb.span_hash(sums, start, end), 3)
    repeated = np.zeros(len(start), bool)
    if len(gram):
        whole = doc_of_word[2:] == doc_of_word[:-2]
        key = gram[whole] + doc_of_word[:-2][whole] * np.uint64(0xA24BAED4963EE407)
        hit = np.flatnonzero(whole)[_seen_before(key)[1]]
        for k in range(3):
            repeated[hit + k] = True
    # lines with a word
    inside = tb.SPACED[data]
    breaks = np.unique(np.concatenate([at, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    a, z = breaks[:-1], breaks[1:]
    worded = _sums(inside, breaks) > 0 if len(breaks) > 1 else np.zeros(0, bool)
    a, z = a[worded], z[worded]
    line_doc = np.searchsorted(at, a, "right") - 1
    key = tb.span_hash(sums, a, z) + line_doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    per_line = np.searchsorted(line_doc, np.arange(b.n + 1))
    per_byte = lambda flags: _sums(flags, at)
    alpha = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ALPHA[data], out=alpha[1:])
    return {
        "n_words": n_words,
        "word_chars": per_byte(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_byte(_SYMBOL[data]),
        "n_lines": np.diff(per_line),
        "n_dup_lines": _sums(_seen_before(key)[0], per_line),
        "n_repeat_words": _sums(repeated, word_at),
        "n_upper": per_byte(_UPPER[data]),
        "n_ascii_letters": per_byte(_UPPER[data] | _LOWER[data]),
        "n_exclaim": per_byte(data == 33),
        "n_alpha_words": _sums(alpha[end] > alpha[start], word_at),
    }


def ledger(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns, `ledger` (a struct of the measurements) and `fail_bits` (bit i: rule i failed) of each row."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*carry, *(["text"] if "text" not in carry else [])]
    given = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))

    def rows(batches):
        for batch in batches:
            for b in tb.blocks(batch.column(names.index("text"))):
                yield {f"_{i}": batch.column(i).slice(b.first, b.n) for i in range(len(carry))} | measure(b)

    schema = ", ".join([f"_{i} {fields[c]}" for i, c in enumerate(carry)] + [f"{m} long" for m in MEASURES])
    out = store.map_arrow(given, rows, schema)
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, cond in enumerate(RULES.values())), F.lit(0).cast("long"))
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)), F.struct(*MEASURES).alias("ledger"), bits.alias("fail_bits"))


def rejected(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rejected rows, rows only it rejects, and rows kept without it."""
    whole = mask(POLICIES[policy])
    found = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    one = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy])))
    each = found.select("bits", "n", one.alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("bits") == F.col("bit"))("n_only"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("n_kept_without"),
    )


def quality(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The contract's columns and the ledger's mask for each document."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(docs, "doc_id").select(
        "doc_id", *(f"ledger.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base.alias("base_failed"),
        (~base & ~rejected(policy)).alias("kept"), "fail_bits",
    )


def accepted(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of `docs` that pass a policy and the base rules, with their columns unchanged."""
    names = docs.columns
    found = ledger(docs, *names).toDF(*(f"_{i}" for i in range(len(names))), "_ledger", "_bits")
    reject = mask({*POLICIES[policy], *BASE})
    return found.where(F.col("_bits").bitwiseAND(F.lit(reject)) == 0).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
