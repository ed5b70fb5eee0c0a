"""Operator 8: language identification by compression.

Each language has a zstandard raw-content dictionary of training texts; a text
belongs to the language whose dictionary compresses it best (Benedetto et al.,
"Language trees and zipping", 2002). Before that, letters are lower-cased and
everything else becomes single spaces. The training sample is bounded per language
(``Training``); every text is classified whole, in blocks of ``block`` bytes whose
sizes are added, so memory doesn't follow the longest text.

Sizes are whole bytes, too coarse for a few words. So a text is compressed with itself
behind it, turned round to several starts, as many as make ``enough`` bytes in all and
one at least, and the sizes are added up. A tie goes to the language with more training
rows, with margin zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import table

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Training:
    """The bounds of the sample: whole texts of a language are taken until there are ``rows`` of them
    or they have ``chars`` characters; those of up to ``usual`` characters come first. More than
    ``languages`` are an error."""

    rows: int = 200
    chars: int = 200_000
    usual: int = 5_000
    languages: int = 1_000


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def train(docs: DataFrame, learn: Column, bounds: Training = Training()) -> list[tuple[str, bytes]]:
    """(language, dictionary), most frequent first, from rows where ``learn`` holds and text and lang are given.

    The sample is of distinct texts with the least hash, so copies of one text count once.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = rows.select("*", (F.length("text") > bounds.usual).alias("late"), F.xxhash64("text", F.lit(8)).alias("h"))
    first = Window.partitionBy("lang").orderBy("late", "h")
    least = rows.select("lang", "late", "h").distinct().select("*", F.row_number().over(first).alias("n")).where(F.col("n") <= bounds.rows)
    found = rows.join(F.broadcast(least.drop("n")), ["lang", "late", "h"], "left_semi").distinct()  # languages x rows hashes at most
    ranked = found.select("lang", "text", F.row_number().over(first.orderBy("late", "h", "text")).alias("n")).where(F.col("n") <= bounds.rows)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("n")) - F.length("text")
    texts = ranked.withColumn("before", before).where(F.col("before") < bounds.chars).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("texts"))
    counts = rows.groupBy("lang").count()
    held = counts.join(texts, "lang").orderBy(F.desc("count"), "lang").limit(bounds.languages + 1).collect()  # bounded by Training, but for each one's last text
    if len(held) > bounds.languages:
        raise ValueError(f"more than {bounds.languages} languages")
    return [(r.lang, plain("\n".join(t.text for t in r.texts)).encode()) for r in held]


def plain(text: str) -> str:
    """Lower-case letters, with single spaces for all else."""
    return _OTHER.sub(" ", text.lower()).strip()


def classifier(dictionaries: list[tuple[str, bytes]], level: int = 6, block: int = 1 << 20, enough: int = 2048):
    """text -> (language, margin, score); margin is the loser's lead in size over the winner, as a share of it."""
    import zstandard

    packers = []
    for _, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    names = [n for n, _ in dictionaries]

    def sizes(text: bytes) -> list[int]:
        parts = [text[i : i + block] for i in range(0, len(text), block)]
        return [sum(len(p.compress(x)) for x in parts) for p in packers]

    def classify(text: str) -> tuple[str, float, float]:
        whole = plain(text).encode()
        starts = range(0, len(whole), max(1, len(whole) * len(whole) // enough))
        turned = (b" ".join((b"", whole, whole[i:], whole[:i])) for i in starts)
        got = [sum(x) for x in zip(*map(sizes, turned))]
        best = min(range(len(got)), key=got.__getitem__)
        second = min((s for i, s in enumerate(got) if i != best), default=2 * got[best])
        margin = (second - got[best]) / second
        return names[best], margin, 0.5 + 0.5 * margin

    return classify


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], narrow: float = 0.001, keep_columns: bool = False, prefix: str = "") -> DataFrame:
    """Each row of ``docs`` with ``lang_pred``, ``margin``, ``score`` and ``rejected``.

    ``rejected``: the text is null or has no letter (then lang_pred is "und" and score
    0), or the margin is ``narrow`` or less. Only the text is looked at; repeated rows are
    judged each. Without any dictionary every row is "und". doc_id and text are what is
    kept unless ``keep_columns``; an empty table gives no rows. ``prefix`` goes before the
    names of the four columns; a column of ``docs`` with such a name, in any case, is left
    out, so choose a prefix that none has to keep them all.
    """
    from pyspark.sql import types as T

    kept = docs if keep_columns else docs.select("doc_id", "text")
    fields = {"lang_pred": T.StringType(), "margin": T.DoubleType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    fields = {prefix + n: t for n, t in fields.items()}
    if clash := {c.lower() for c in kept.columns} & set(fields):
        kept = kept.drop(*clash)
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in fields.items())])
    held = kept.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by Training

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(held.value) if held.value else None
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if classify is None or text is None or not _LETTER.search(text):
                    out.append(("und", 0.0, 0.0, True))
                else:
                    name, margin, score = classify(text)
                    out.append((name, margin, score, margin <= narrow))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return kept.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose id's crc32 isn't divisible by 5."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of_id() % 5 == 0
    found = identify(docs, train(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
