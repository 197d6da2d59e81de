"""How often every value, term or term sequence occurs, and in how many records (problem 5).

Method: suffix-sorted n-gram counting. Every record's suffixes, truncated to
``max_n`` terms, are routed by their leading terms, sorted in reverse lexicographic
order, and one pass with a stack gives the counts of all their prefixes.

Records are counted without carrying sets of ids. Inside a record the suffixes
are sorted, and each notes how long a prefix it shares with the one before
(``lcp``): it is the record's first suffix with a given prefix exactly when the
prefix is longer than that. Counts of records are then sums, so equal
(suffix, lcp) pairs are added up before they are shuffled, and a hot first term may span
several range partitions whose partial sums are added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _suffixes(terms: Column, max_n: int) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.size(terms)), lambda i: F.slice(terms, i, F.lit(max_n)))
    return F.when(F.size(terms) > 0, F.sort_array(cut))


def _shared(a: Column, b: Column, max_n: int) -> Column:
    """Length of the common prefix of two term arrays."""
    n = F.lit(0)
    for k in range(max_n, 0, -1):
        same = (F.size(a) >= k) & (F.size(b) >= k) & (F.slice(a, 1, k) == F.slice(b, 1, k))
        n = F.when(same, F.lit(k)).otherwise(n) if k == max_n else F.when(n > k, n).when(same, F.lit(k)).otherwise(n)
    return n


def _stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffixes in reverse lexicographic order to partial counts of all their prefixes.

    The stack holds the current suffix's terms; level k keeps the sums of the prefix of
    k + 1 terms, which is finished when a suffix arrives that doesn't share it.
    """
    terms: list[str] = []
    sums: list[list[int]] = []
    for pdf in batches:
        out: list[tuple[list[str], int, int]] = []
        for suffix, lcp, n in zip(pdf["suffix"], pdf["lcp"], pdf["n"]):
            suffix = list(suffix)
            same = 0
            while same < len(terms) and same < len(suffix) and terms[same] == suffix[same]:
                same += 1
            while len(terms) > same:
                occurrences, records = sums.pop()
                out.append((terms.copy(), occurrences, records))
                terms.pop()
            for t in suffix[same:]:
                terms.append(t)
                sums.append([0, 0])
            for k, s in enumerate(sums):
                s[0] += n
                if k >= lcp:
                    s[1] += n
        yield pd.DataFrame(out, columns=["gram", "occurrences", "records"])
    out = []
    while terms:
        occurrences, records = sums.pop()
        out.append((terms.copy(), occurrences, records))
        terms.pop()
    yield pd.DataFrame(out, columns=["gram", "occurrences", "records"])


def sequence_counts(records: DataFrame, terms: str, max_n: int = 1) -> DataFrame:
    """gram (array of 1..max_n terms), occurrences, records.

    ``records`` holds one row per record, ``terms`` its terms in order (array of strings).
    Null terms are skipped, null or empty arrays count nothing; records of any
    length are taken whole. Other columns are not read.
    """
    clean = records.select(F.filter(F.col(terms), lambda t: t.isNotNull()).alias("_t"))
    # a column of its own: inside the lambda an expression would be worked out again for every suffix
    sorted_ = clean.select(_suffixes(F.col("_t"), max_n).alias("_all"))
    per_record = sorted_.select(F.explode(_with_lcp(F.col("_all"), max_n)).alias("_s"))
    counted = per_record.groupBy(F.col("_s.suffix").alias("suffix"), F.col("_s.lcp").alias("lcp")).agg(
        F.count(F.lit(1)).alias("n")
    )
    routed = counted.repartitionByRange("suffix").sortWithinPartitions(F.desc("suffix"))
    parts = routed.mapInPandas(_stack, "gram array<string>, occurrences bigint, records bigint")
    return parts.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _with_lcp(suffixes: Column, max_n: int) -> Column:
    def one(s: Column, i: Column) -> Column:
        before = F.get(suffixes, i - 1)
        return F.struct(
            s.alias("suffix"), F.when(i == 0, F.lit(0)).otherwise(_shared(before, s, max_n)).alias("lcp")
        )

    return F.transform(suffixes, one)


def categorical_records(rows: DataFrame, id_col: str, cat_cols: list[str]) -> DataFrame:
    """id, terms: one record per id, its ``column=value`` terms in column order; nulls are no value.

    Rows repeated under one id make one record: their values are joined, and a
    value that several of them hold counts once. Null ids are left out.
    """
    terms = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c))) for c in cat_cols])
    )
    # equal repeats vanish in the pre-aggregation; only repeats that differ are joined
    rows = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), terms.alias("terms")).distinct()
    return rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def value_marks(
    rows: DataFrame, id_col: str, cat_cols: list[str], *, rare_below: int = 5, common_above: float = 0.5
) -> DataFrame:
    """cat_col, cat_value, occurrences, records, mark of every stored value.

    ``mark`` is ``rare`` below ``rare_below`` distinct ids, ``common`` above the share
    ``common_above`` of all distinct ids (rare wins), else null.
    """
    records = categorical_records(rows, id_col, cat_cols)
    counts = sequence_counts(records, "terms", 1)
    total = rows.agg(F.count_distinct(id_col).alias("total"))  # one row
    term = F.get("gram", F.lit(0))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("total") * common_above, "common")
    return counts.crossJoin(F.broadcast(total)).select(
        F.substring_index(term, "=", 1).alias("cat_col"),
        F.expr("substring(get(gram, 0), instr(get(gram, 0), '=') + 1)").alias("cat_value"),
        "occurrences",
        "records",
        mark.alias("mark"),
    )
