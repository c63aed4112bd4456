import zlib

from pyspark.sql import functions as F

from trialstats.llm import language as L

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = L.op8_language(spark, SF).join(docs, "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(rows.doc_id, rows.held_out))
    rows = rows[rows.held_out]
    right = rows.lang == rows.lang_pred
    assert right.mean() > 0.99 and right[rows.n > 300].mean() > 0.998
    assert rows.score.between(0, 1).all()
    assert right[~rows.rejected].mean() >= right.mean()


def test_odd_rows(spark, odd_documents, no_documents):
    rows = L.identify(odd_documents).collect()
    got = {r.doc_id: r.found for r in rows}
    assert len(rows) == 9 and all(got[i].lang == "und" and got[i].score == 0 for i in (2, 3, 5))
    assert got[1].lang in ("en", "de", "fr") and got[7].lang != "und"
    assert L.identify(no_documents).count() == 0
    unlabelled = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.found.lang for r in L.identify(unlabelled).collect()} == {"und"}


def test_sizes_are_plain_zstandard(spark):
    import zstandard as z

    by = L.Compressors({"a": b"the quick brown fox jumps over the lazy dog " * 9, "b": b"der schnelle braune fuchs springt " * 9})
    assert by.predict("The lazy dog jumps OVER the brown fox!")["lang"] == "a"
    assert by.predict("ein fuchs springt, der braune")["lang"] == "b"
    data = b"the lazy dog " * 1000
    whole = sum(
        len(z.ZstdCompressor(level=L.LEVEL, dict_data=z.ZstdCompressionDict(
            b"the quick brown fox jumps over the lazy dog " * 9, dict_type=z.DICT_TYPE_RAWCONTENT),
            write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[k : k + L.BLOCK]))
        for k in range(0, len(data), L.BLOCK))
    assert abs(by.sizes(data)[0] - whole) <= 0.05 * whole + 8
