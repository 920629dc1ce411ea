"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document is measured and put to RULES. Failures are counted per host (column
`source`), and each host's failure rate of a rule is shrunk towards the mean rate with
a beta prior fitted by moments over the hosts. A host is condemned if a shrunk rate
lies above the prior's mean by more than DEVIATIONS of its own posterior's standard
deviations: the limit follows from the data, so rates that are high everywhere condemn
nobody, and a host that stands out is condemned at a low rate, too. The verdicts
are joined back to the documents: a document of a condemned host is kept only if it
passes every rule itself; any other one is kept unless the base rule fails. So a
document without a failure is always kept.

Null texts have no words, so the base rule fails; so do empty ones. A text of any length
is measured whole, in one row of one task. A null host is a host like any other, and a host
with a third of all rows is pre-counted in each task. Each row is judged by itself; repeated
rows count repeatedly for their host, and a rate at the limit (a tie) condemns nobody. An
empty table gives none. Only the columns named are read, so that others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import col
from .staging import settle

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
DEVIATIONS = 1.5
#: The prior counts for at least so many documents, so that one failure doesn't condemn a small host.
LEAST_STRENGTH = 5.0
#: Rules besides the base rule: a document fails if the condition holds.
MAX_SYMBOL_SHARE = 0.10
MAX_DUP_LINE_SHARE = 0.30
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.0, 15.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows that stand twice or more in `words`."""
    n = F.size(words)
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        own = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def neighbours(ordered: Column, field: str) -> Column:
        """Of structs sorted by a field, those that share it with another one."""
        return F.filter(
            ordered,
            lambda x, k: F.coalesce(F.get(ordered, k - 1)[field] == x[field], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)[field] == x[field], F.lit(False)),
        )

    def repeats(ordered: Column) -> Column:
        # Equal hashes, then equal words: a clash of hashes makes no repeat.
        said = F.transform(
            neighbours(ordered, "h"), lambda x: F.struct(F.concat_ws(" ", *(F.get(words, x["i"] + k) for k in range(WINDOW))).alias("w"), x["i"].alias("i"))
        )
        twice = let(F.sort_array(said), lambda o: neighbours(o, "w"))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), repeats))

    return let(hashes, count)


def measures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """doc_id, host and the measures of every row."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(t, WHITE, -1), "")
    plain = docs.select(
        col(doc_id).alias("doc_id"), col(host).cast("string").alias("host"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
    )
    return plain.select(
        "doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"),
        "w.n_repeat_words", F.col("l.n").alias("n_lines"),
    )


def rules() -> dict[str, Column]:
    """Whether a measured document fails, by rule; no division, so empty texts are safe."""
    return {
        "base": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbols": F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"),
        "word_length": (F.col("word_chars") < MIN_MEAN_WORD * F.col("n_words")) | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words")),
    }


def host_verdicts(failed: DataFrame) -> DataFrame:
    """host and condemned, from rows of host and a boolean column per rule.

    The prior of a rule has the mean m and variance v of the hosts' rates: its strength
    is m(1-m)/v - 1, at least LEAST_STRENGTH, and as a few constants per rule it comes to the driver.
    Hosts all alike have no variance; then the prior outweighs any host.
    """
    names = [n for n in failed.columns if n != "host"]
    hosts = failed.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in names))
    rates = hosts.select("host", "n", *(F.col(r) for r in names))
    moments = rates.agg(
        F.count("*").alias("hosts"),
        *(F.avg(F.col(r) / F.col("n")).alias(f"{r}_m") for r in names),
        *(F.var_pop(F.col(r) / F.col("n")).alias(f"{r}_v") for r in names),
    ).first()
    condemned = F.lit(False)
    for r in names:
        m, v = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        strength = max(LEAST_STRENGTH, m * (1 - m) / v - 1) if v > 1e-12 else 1e12
        shrunk, weight = (F.col(r) + m * strength) / (F.col("n") + strength), F.col("n") + strength
        condemned = condemned | (shrunk - m > DEVIATIONS * F.sqrt(shrunk * (1 - shrunk) / (weight + 1)))
    return rates.select("host", condemned.alias("condemned"))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """The measures of every row with base_failed, host_condemned and kept."""
    rows = settle(measures(docs, text, doc_id, host), "measures")
    marked = rows.select("*", *(x.alias(f"_{r}") for r, x in rules().items()))
    names = [f"_{r}" for r in rules()]
    verdicts = host_verdicts(marked.select("host", *names)).withColumnRenamed("host", "_host")
    judged = marked.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    any_failed = F.lit(False)
    for n in names:
        any_failed = any_failed | F.col(n)
    return judged.select(
        *rows.columns, F.col("_base").alias("base_failed"), F.col("condemned").alias("host_condemned"),
        (~F.col("_base") & ~(F.col("condemned") & any_failed)).alias("kept"),
    )
