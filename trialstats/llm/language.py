"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of a bounded sample of its labelled texts. A text is
reduced to its lower-case letters (shouting, tables and symbols would blur the sizes) and cut
into blocks of ``BLOCK`` bytes, every block is encoded with the dictionary of every language, and the language with
the smallest total wins. Blocks keep the dictionary in charge: within one long frame a text would soon predict itself.
A prediction whose margin over the second is below ``MARGIN`` of its own size is marked as rejected.

The sample: of the rows that are not held out and carry a language, the row with the least id hash in each of
``SAMPLES`` hash buckets per language, ``PIECE`` characters each, so at most ``SAMPLES * PIECE`` characters a language.

Cases: a null text, or one without a letter, is ``und`` with score 0; equal sizes go to the language with more
training rows, then to the lesser name; without any training row everything is ``und``; rows whose lang is null are
predicted but never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import held_out, table

SAMPLES = 256
PIECE = 400
BLOCK = 4096
LEVEL = 9
#: all dictionaries are cut to the shortest one's size, but not below this
LEAST_DICTIONARY = 16_384
#: share of the smallest size by which the second must be larger
MARGIN = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_PREDICTION = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
])


def fit(docs: DataFrame, samples: int = SAMPLES, piece: int = PIECE) -> dict[str, bytes]:
    """Dictionary bytes by language, the language with most training rows first."""
    own = docs.select("doc_id", "text", F.col("lang").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.withColumn("_hash", F.xxhash64("doc_id"))
    bucket = F.pmod("_hash", F.lit(samples)).alias("bucket")
    least = own.groupBy("lang", bucket).agg(F.min("_hash").alias("h"), F.count("*").alias("n")).collect()
    rows: dict[str, int] = {}
    for r in least:
        rows[r.lang] = rows.get(r.lang, 0) + r.n
    chosen = own.where(F.col("_hash").isin([r.h for r in least])).select(
        "lang", "_hash", F.substring("text", 1, piece).alias("piece")).dropDuplicates(["lang", "_hash"])
    pieces: dict[str, list] = {}
    for r in chosen.collect():  # at most ``samples`` short pieces a language
        pieces.setdefault(r.lang, []).append((r._hash, r.piece))
    order = sorted(pieces, key=lambda x: (-rows[x], x))
    data = {x: letters(" ".join(p for _, p in sorted(pieces[x]))) for x in order}
    size = max(LEAST_DICTIONARY, min(map(len, data.values()), default=0))  # equal sizes make equal offsets
    return {x: d[-size:] for x, d in data.items()}


def letters(text: str) -> bytes:
    """Lower-case letters of a text, with one space for whatever stands between."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


class Compressors:
    """Sizes of a text under the dictionary of each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names, self.by = list(dictionaries), []
        for data in dictionaries.values():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(z.ZstdCompressor(
                level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> np.ndarray:
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.by])

    def predict(self, text: str | None) -> dict:
        if text is None or not self.names or not _LETTER.search(text):
            return {"lang": UNKNOWN, "score": 0.0, "margin": 0.0, "rejected": True}
        sizes = self.sizes(letters(text))
        best = int(np.argmin(sizes))
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        margin = float(second - sizes[best]) / float(sizes[best])
        score = 1 / float(np.exp2(-np.minimum(sizes - sizes[best], 60)).sum())
        return {"lang": self.names[best], "score": score, "margin": margin, "rejected": margin < MARGIN}


def predictor(spark, dictionaries: dict[str, bytes]):
    """Column function: text to struct of lang, score, margin and rejected."""
    shared = spark.sparkContext.broadcast(dictionaries)

    @F.arrow_udf(_PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = Compressors(shared.value)
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])
        for texts in batches:
            yield pa.array([by.predict(t.as_py()) for t in texts], kind)

    return predict


def identify(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, held_out and the prediction of each row of ``docs``, learned from the rows that are not held out."""
    predict = predictor(docs.sparkSession, fit(docs))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        predict(F.col("text") if text is None else text).alias("found"))


def op8_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.col("found.margin").alias("margin"), F.col("found.rejected").alias("rejected"))
