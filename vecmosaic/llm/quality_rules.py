"""Quality rules for documents with verdicts at host level, in DataFrame expressions only.

Each document is measured in one pass over its whole text.  Rule failures are then counted by
host, every host's failure rate is shrunk with a beta prior fitted to all hosts by moments, and
the host's verdict is joined back to its documents.

Defined results: a null or empty text has no words and fails the base rules; a null host is a
host of its own; repeated rows are measured and counted one by one; an empty table gives an
empty result; very long texts are measured whole; other columns of the input, whatever their names,
are left out of the measures.  A host is a URL's host name in lower case, or the value as it is.
A window is compared by the 64-bit hash of its eight words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmosaic.llm.names import unused
from vecmosaic.session import written

GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class QualityOptions:
    window: int = 8
    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10  # symbols against characters in words
    max_dup_line_pct: int = 30  # repeated lines against lines with a word
    host_limit: float = 0.5  # a host goes when its shrunk failure rate passes this
    default_strength: float = 20.0  # prior weight in documents when the hosts don't differ
    max_strength: float = 10_000.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows at these ascending starts cover together."""
    step = lambda acc, p: F.struct(
        (acc["n"] + F.lit(width) - F.greatest(F.lit(0), acc["to"] - p)).cast("long").alias("n"), (p + width).cast("int").alias("to")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def measured(df: DataFrame, text: str, names: tuple[str, str, str], options: QualityOptions = QualityOptions()) -> DataFrame:
    """The input with the columns ``q`` (a struct of the measures), ``base`` and ``fails`` under the names given."""
    q_name, base, fails = names
    words, keys, ties, starts, kept_lines = unused(df, "words", "keys", "ties", "starts", "lines")
    w = options.window
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn(words, words_of(F.col(text)))
    # every stage refers to the array before it more than once, so it stays a column of its own
    out = out.withColumn(
        keys,
        F.when(F.size(words) > w, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (w - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, w)))),
    )
    out = out.withColumn(
        ties,
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))),
    )
    same = lambda x, i: F.coalesce(x["k"] == F.get(ties, i - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(ties, i + 1)["k"], F.lit(False))
    out = out.withColumn(starts, F.when(F.col(ties).isNotNull(), F.sort_array(F.transform(F.filter(ties, same), lambda x: x["i"]))))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(kept_lines, lines)
    out = out.withColumn(
        q_name,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size(kept_lines) - F.size(F.array_distinct(kept_lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(_covered(F.col(starts), w), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(kept_lines).cast("long").alias("n_lines"),
        ),
    ).drop(words, keys, ties, starts, kept_lines)
    q = F.col(q_name)
    return out.withColumn(
        base, (q["n_words"] < options.min_words) | (100 * q["n_repeat_words"] > options.max_repeat_pct * q["n_words"])
    ).withColumn(
        fails,
        F.col(base).cast("int")
        + (100 * q["n_symbols"] > options.max_symbol_pct * q["word_chars"]).cast("int")
        + (100 * q["n_dup_lines"] > options.max_dup_line_pct * q["n_lines"]).cast("int"),
    )


def host_name(source: str) -> Column:
    """The host of a URL in lower case; any other value stands for itself."""
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host)).otherwise(F.col(source))


def host_verdicts(docs: DataFrame, host: str, fails: str, options: QualityOptions = QualityOptions()) -> DataFrame:
    """One row per host: documents, failing documents, shrunk rate and verdict.

    The counts are combined before the shuffle, so a host with a third of all rows is a few partial
    counts.  The prior comes from one row of sums: the variance of the hosts' rates less the part
    that the sizes of the hosts alone explain gives the correlation inside a host, and that the
    strength.
    """
    hosts = docs.groupBy(F.col(host).alias("of_host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum((F.col(fails) > 0).cast("long")).alias("host_failed")
    )
    hosts = written(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    rho = (F.try_divide("v", F.col("m") * (1 - F.col("m"))) - F.col("noise")) / (1 - F.col("noise"))
    sums = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("noise")
    ).select(
        "m",
        F.when(
            (F.col("m") > 0) & (F.col("m") < 1) & (F.col("noise") < 1),
            1 / F.greatest(F.least(rho, F.lit(0.5)), F.lit(1 / (1 + options.max_strength))) - 1,
        ).otherwise(F.lit(options.default_strength)).alias("s"),
    )
    strength, mean = sums.select("s").scalar(), sums.select("m").scalar()
    shrunk = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > options.host_limit)


def quality_verdicts(docs: DataFrame, options: QualityOptions = QualityOptions(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: the measures, ``base_failed``, the host's figures and ``kept``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source"))
    narrow = narrow.withColumn("source", host_name("source"))
    scored = written(measured(narrow, "text", ("q", "base", "fails"), options).drop("text"), "quality")
    hosts = host_verdicts(scored, "source", "fails", options)
    joined = scored.join(hosts, F.col("source").eqNullSafe(F.col("of_host")), "left")
    return joined.select(
        "doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
        F.col("base").alias("base_failed"),
        (~F.col("base") & ~F.coalesce(F.col("host_rejected"), F.lit(False))).alias("kept"),
        F.col("fails").alias("rules_failed"),
        F.round("host_rate", 9).alias("host_rate"),
    )


def quality_filter(docs: DataFrame, options: QualityOptions = QualityOptions(), text: str = "text", host: str = "source") -> DataFrame:
    """The input's rows that pass, with the input's columns.

    Every text is measured once: the rows are written with their failures, the hosts are counted
    from two narrow columns, and the rows come back without those that fail or whose host does.
    Only the rejected hosts are joined, and Spark broadcasts them only where their written size is
    under the session's own limit.
    """
    cols = docs.columns
    q, base, fails, of = unused(docs, "q", "base", "fails", "host")
    named = docs.withColumn(of, host_name(host))
    rows = written(measured(named, text, (q, base, fails), options).drop(q), "measured")
    bad = written(host_verdicts(rows, of, fails, options).where("host_rejected").select("of_host"), "bad-hosts")
    good = rows.where(~F.col(base)).join(bad.withColumnRenamed("of_host", of + "_"), F.col(of).eqNullSafe(F.col(of + "_")), "left_anti")
    return good.select(*cols)
