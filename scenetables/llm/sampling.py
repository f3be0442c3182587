"""Bounded training samples of labelled documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 3, 1
#: Characters of a sample as a whole: what the driver, or the task that trains, holds.
SAMPLE_CHARS = 160_000_000
#: Up to so many labels their shares, and the chosen ids, are broadcast; beyond, Spark chooses the join.
BROADCAST_LABELS = 10_000


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS, F.lit(HELD_OUT))


def held_out(id_col: Column) -> Column:
    return fold(id_col) == HELD_OUT


def sample_rows(docs: DataFrame, label: str, per_label: int, max_chars: int, labels: DataFrame | None = None) -> DataFrame | None:
    """(text, label, __p): at most per_label rows for each label, chosen by a hash of the id, for fitting in one place; ordered by __p and text they are always the same list.

    docs(doc_id, text) has the label, or labels(doc_id, label) does, a row for each id. Only rows of at most max_chars
    characters are taken, and taken whole. All labels share SAMPLE_CHARS characters: where there are many, each gets fewer rows, one at least, and beyond a row of max_chars for
    each label only shorter texts are taken. Counting goes over all rows, without their texts; the hash threshold of a label is its share, so what is ranked
    within a label is a few rows more than are wanted, and no more than SAMPLE_CHARS characters are left. The chosen ids are sent to the texts, not the texts to them.
    The choice depends on ids, labels and texts alone, not on the order of rows. Null texts and labels are left out; without labels there is none."""
    known = docs.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("__n", F.length("text"))
    tagged = known if labels is None else known.drop(label).join(labels.select("doc_id", label), "doc_id")
    n_labels = tagged.filter(F.col(label).isNotNull() & (F.col("__n") <= max_chars)).select(label).distinct().count()
    if not n_labels:
        return None
    max_chars = min(max_chars, max(1, SAMPLE_CHARS // n_labels))
    per_label = max(1, min(per_label, SAMPLE_CHARS // (max_chars * n_labels)))
    usable = known.filter(F.col("__n") <= max_chars).drop("__n")
    narrow = usable.select("doc_id", *([label] if labels is None else []))
    narrow = (narrow if labels is None else narrow.join(labels.select("doc_id", label), "doc_id")).filter(F.col(label).isNotNull())
    share = narrow.groupBy(F.col(label).alias("__label")).agg(F.least(F.lit(1.0), F.lit(1.1 * per_label + 5) / F.count("*")).alias("__share"))
    send = F.broadcast if n_labels <= BROADCAST_LABELS else (lambda d: d)
    point = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)).alias("__p")

    def few(d: DataFrame, *cols: str) -> DataFrame:
        some = d.join(send(share), F.col(label) == F.col("__label")).filter(F.col("__p") < F.col("__share")).select(*cols, label, "__p")
        return some.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy("__p", *cols))).filter(F.col("__r") <= per_label)

    if labels is None:
        found = few(usable.filter(F.col(label).isNotNull()).select("text", label, point), "text")
    else:
        chosen = few(narrow.select("doc_id", label, point).distinct(), "doc_id").select("doc_id", label, "__p")
        texts = usable.select("doc_id", "text").join(send(chosen), "doc_id")
        # an id of several texts may bring more rows than were chosen
        found = texts.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy("__p", "text"))).filter(F.col("__r") <= per_label)
    return found.select("text", label, "__p")


def in_order(rows: Iterable[tuple]) -> list[tuple[str, object]]:
    """(text, label) of rows of sample_rows()."""
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], r[0]))]


def bounded_sample(docs: DataFrame, label: str, per_label: int, max_chars: int, labels: DataFrame | None = None) -> list[tuple[str, object]]:
    """The pairs of sample_rows(), collected for fitting on the driver; an empty table gives an empty list."""
    found = sample_rows(docs, label, per_label, max_chars, labels)
    return [] if found is None else in_order(found.collect())
