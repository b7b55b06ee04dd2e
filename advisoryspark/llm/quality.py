"""Host-level quality rules over document features (free style: numpy inside tasks).

Each rule's failures are counted per host, the rates are shrunk with a beta
prior fitted to the hosts themselves, and the hosts' verdicts are joined back.

Defined cases: a null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows are judged and counted each on its
own; an empty table gives an empty result; other columns of the input are
ignored by `features` and kept out of its result, so names cannot clash; a shrunk
rate exactly at the limit rejects no host; a very long text is counted whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import each_step, materialize, texts, word_table

SYMBOLS = b"#*$%&|<>"
#: White space and the bytes that continue a UTF-8 character.
_NOT_COUNTED = bytes([32, *range(9, 14), *range(0x80, 0xC0)])
WINDOW = 5

_SCHEMA = "id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, " \
          "n_dup_lines long, n_repeat_words long"


def repeat_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that the text holds twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    _, codes = np.unique(codes, return_inverse=True)
    rank = codes[:n].astype(np.int64)
    for i in range(1, window):  # rank of the first i + 1 words of each window
        _, rank = np.unique(rank * len(codes) + codes[i:i + n], return_inverse=True)
    hit = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    starts, codes, _ = word_table(batch.column("text"))
    rows = []
    for i, raw in enumerate(batch.column("text").to_pylist()):
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rows.append((starts[i + 1] - starts[i], len(raw.translate(None, _NOT_COUNTED)),
                     len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
                     repeat_words(codes[starts[i]:starts[i + 1]])))
    counts = np.array(rows, np.int64).reshape(-1, 6)
    return pa.record_batch([batch.column("id"), batch.column("host"), *(pa.array(counts[:, k]) for k in range(6))],
                           names=["id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                                  "n_repeat_words"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source") -> DataFrame:
    """One row of counts per document, from its whole text; no shuffle."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), texts(text_col).alias("text"))
    return narrow.mapInArrow(lambda it: each_step(it, "text", _measure), _SCHEMA)


def rules() -> dict[str, Column]:
    """Name and failure condition of each rule over the columns of `features`."""
    words = F.col("n_words")
    return {
        "few_words": words < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words),
        "symbols": 10 * F.col("n_symbols") > words,
        "same_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """Documents and failures of each rule per host; a hot host is summed up before the shuffle."""
    return measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(
        F.sum(F.when(fails, 1).otherwise(0)).alias(name) for name, fails in rules().items()))


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) per rule by the method of moments over the hosts' raw rates.

    One aggregated row comes to the driver.  Without spread between hosts the
    prior weighs 1000 documents; it never weighs less than one.
    """
    names = list(rules())
    row = hosts.agg(*(x for name in names for x in (
        F.avg(F.col(name) / F.col("n")).alias(f"m_{name}"),
        F.var_pop(F.col(name) / F.col("n")).alias(f"v_{name}")))).first()
    priors = {}
    for name in names:
        mean, spread = row[f"m_{name}"] or 0.0, row[f"v_{name}"] or 0.0
        weight = 1000.0 if spread <= 0 else min(1000.0, max(1.0, mean * (1 - mean) / spread - 1))
        priors[name] = (mean * weight, (1 - mean) * weight)
    return priors


def host_verdicts(hosts: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Hosts with their shrunk rates; a host is rejected if any of them is over `max_rate`."""
    priors = beta_priors(hosts)
    rates = {name: (F.col(name) + a) / (F.col("n") + a + b) for name, (a, b) in priors.items()}
    return hosts.select("host", *(rate.alias(f"rate_{name}") for name, rate in rates.items()),
                        (F.greatest(*rates.values()) > max_rate).alias("host_rejected"))


def judge(docs: DataFrame, max_rate: float = 0.5, **columns) -> DataFrame:
    """Features, the document's own verdict `base_failed`, and `kept` after its host's verdict.

    The features are written once, as both the hosts' sums and the join read
    them.  The hosts' side holds a row per host, so a hot host only lengthens
    the documents' side, which adaptive execution splits.
    """
    measured = materialize(features(docs, **columns), "quality")
    verdicts = host_verdicts(host_rates(measured), max_rate).withColumnRenamed("host", "verdict_host")
    base = rules()["few_words"] | rules()["repeats"]
    return (measured.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left")
            .withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))
