"""Queries over the sources and sinks: tables go out in each format and are read back."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from batchloom.plans.registry import query
from batchloom.session import scratch, spread, table
from batchloom.sources import binary, files, splitter, text

# The white space class of batchloom.sources.text, for DuckDB.
WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"

DOC_LINES = rf"""
  doc_lines AS (
    SELECT doc_id, doc_id // 256 AS bucket, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM documents),
  kept AS (
    SELECT *, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS value FROM doc_lines)
"""


def document_lines(spark, sf, per_file=256):
    """Text files of document lines, one file for each ``per_file`` document numbers."""
    path = scratch(spark, "lines")
    lines = table(spark, sf, "documents").select(
        "doc_id", F.expr(f"doc_id div {per_file}").alias("bucket"), F.posexplode(F.split("text", "\n")).alias("line_no", "value")
    )
    text.write_lines(lines, path, "bucket", ["doc_id", "line_no"], "value")
    return path


@query(f"""WITH {DOC_LINES}
SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, line_no) AS record_no, value
FROM kept WHERE length(value) > 0""")
def read_text_records(spark, sf):
    records = text.read_text_records(spark, document_lines(spark, sf))
    return records.select(F.col("bucket").cast("bigint").alias("bucket"), "record_no", "value")


@query("""SELECT page_id // 512 AS bucket, row_number() OVER (PARTITION BY page_id // 512 ORDER BY page_id) - 1 AS line_no,
       url AS path FROM pages""")
def read_file_list(spark, sf):
    path = scratch(spark, "manifest")
    pages = table(spark, sf, "pages").withColumn("bucket", F.expr("page_id div 512"))
    text.write_lines(pages, path, "bucket", ["page_id"], "url")
    return text.read_file_list(spark, path).select(F.col("bucket").cast("bigint").alias("bucket"), "line_no", "path")


@query(f"""WITH {DOC_LINES}
SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, line_no) AS idx, value AS record
FROM kept WHERE length(value) > 0""")
def splitter_source(spark, sf):
    folder = document_lines(spark, sf)
    names = spark.read.text(folder).inputFiles()
    splitter.register_splitter(spark, "line_splitter", splitter.line_splitter())
    rows = spark.read.format("line_splitter").option("files", json.dumps(names)).load()
    bucket = F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint")
    return rows.select(bucket.alias("bucket"), "idx", "record")


TSV = rf"""
  clean AS (
    SELECT d.doc_id, d.doc_id // 256 AS bucket, l.quality,
           trim(regexp_replace(d.text, '{WS}+', ' ', 'g')) AS line
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def sample_tsv(spark, sf):
    """Samples as tab-separated lines; documents without a label give rows of two fields."""
    path = scratch(spark, "tsv")
    docs = table(spark, sf, "documents").where(text.has_words(F.col("text")))
    rows = docs.join(table(spark, sf, "labels"), "doc_id", "left").withColumn("line", text.one_line(F.col("text"))).select(
        "doc_id",
        F.expr("doc_id div 256").alias("bucket"),
        F.concat_ws("\t", "line", F.lower("line"), F.col("quality").cast("string")).alias("value"),
    )
    text.write_lines(rows, path, "bucket", ["doc_id"], "value")
    return path


@query(f"""WITH {TSV}
SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS guid, line AS text, quality::VARCHAR AS label
FROM clean WHERE quality IS NOT NULL AND length(line) > 0""")
def read_tsv_records(spark, sf):
    good, _ = text.read_tsv_records(spark, sample_tsv(spark, sf))
    return good.select(F.col("bucket").cast("bigint").alias("bucket"), "guid", "text", "label")


@query(f"""WITH {TSV}
SELECT bucket, 2 AS n_fields, count(*) AS n_rows FROM clean WHERE quality IS NULL AND length(line) > 0 GROUP BY bucket""")
def quarantine_tsv_records(spark, sf):
    _, bad = text.read_tsv_records(spark, sample_tsv(spark, sf))
    return bad.groupBy(F.col("bucket").cast("bigint").alias("bucket"), "n_fields").agg(F.count(F.lit(1)).alias("n_rows"))


@query(rf"""SELECT conv_id, turn, role, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS text FROM conversations""")
def read_multi_file(spark, sf):
    turns = table(spark, sf, "conversations")
    path = scratch(spark, "turns")
    turns.select("role", F.concat_ws("\t", "conv_id", "turn", text.one_line(F.col("text"))).alias("value")).write.partitionBy(
        "role"
    ).text(path)
    parts = F.split("value", "\t")
    both = spark.read.option("basePath", path).text([f"{path}/role={r}" for r in ("system", "user", "assistant")])
    return both.select(
        parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"), "role", parts[2].alias("text")
    )


@query("""SELECT 'data/train/' || replace(regexp_replace(p.url, '[^A-Za-z0-9/.]', '_', 'g') || '.JPEG', 'JPEG', 'jpeg') AS path,
       coalesce(l.quality, 0) AS label
FROM pages p LEFT JOIN labels l ON p.page_id = l.doc_id""")
def read_labelled_list(spark, sf):
    path = scratch(spark, "images")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    table(spark, sf, "pages").join(labels, "page_id", "left").select(
        F.concat(F.regexp_replace("url", "[^A-Za-z0-9/.]", "_"), F.lit(".JPEG "), F.coalesce("quality", F.lit(0)))
    ).write.text(path)
    return text.read_labelled_list(spark, path, "train", "data")[0]


CTR_SUM = " + ".join(f"(l_partkey * {j} + l_suppkey) % 100003" for j in range(1, 27))
DENSE_SUM = " + ".join(f"(l_quantity::BIGINT * {i}) % 97" for i in range(1, 14))


def click_log(spark, sf, cut="false"):
    """Line items as a click log; the lines where ``cut`` holds lack their last attribute."""
    path = scratch(spark, "clicks")
    attributes = [F.when(F.col("l_returnflag") == "R", 1).otherwise(0)]
    attributes += [F.pmod(F.col("l_quantity").cast("bigint") * i, F.lit(97)) for i in range(1, 14)]
    attributes += [F.pmod(F.col("l_partkey") * j + F.col("l_suppkey"), F.lit(100003)) for j in range(1, 27)]
    rows = spread(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_partkey", "l_suppkey", "l_linenumber"))
    *texts, last = [a.cast("string") for a in attributes]
    rows.select(F.concat_ws(" ", *texts, F.when(~F.expr(cut), last))).write.text(path)
    return path


@query(f"""SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, (l_partkey + l_suppkey) % 100003 AS c1,
       (l_partkey * 26 + l_suppkey) % 100003 AS c26, {DENSE_SUM} AS dense_sum, {CTR_SUM} AS sparse_sum
FROM lineitem""")
def read_ctr_records(spark, sf):
    records, _ = text.read_ctr_records(spark, click_log(spark, sf))
    ids = F.lit(0).cast("bigint")
    for i in range(1, 27):
        ids = ids + F.col(f"C{i}")[0]
    total = F.aggregate("dense", F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return records.select(
        "label", F.col("C1")[0].alias("c1"), F.col("C26")[0].alias("c26"), total.alias("dense_sum"), ids.alias("sparse_sum")
    )


@query("""SELECT CASE WHEN l_linenumber = 5 THEN 39 ELSE 40 END AS n_fields, l_linenumber <> 5 AS good, count(*) AS n_rows FROM lineitem GROUP BY ALL""")
def quarantine_ctr_records(spark, sf):
    """Click lines that lack an attribute are set aside, the others are read."""
    good, bad = text.read_ctr_records(spark, click_log(spark, sf, "l_linenumber = 5"))
    both = good.select((1 + F.size("dense") + 26).alias("n_fields"), F.lit(True).alias("good")).unionByName(
        bad.select("n_fields", F.lit(False).alias("good"))
    )
    return both.groupBy("n_fields", "good").agg(F.count(F.lit(1)).alias("n_rows"))


PLACE_SUM = "round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 6) + 0.0"
VECTOR_ROWS = f"""SELECT vec_id, len(embedding) AS dim, embedding[1]::DOUBLE AS first_value,
       embedding[len(embedding)]::DOUBLE AS last_value, {PLACE_SUM} AS place_sum FROM embeddings"""


def place_sum(vector):
    """One number that depends on every element of a vector and its place."""
    weighed = F.transform(vector.cast("array<double>"), lambda x, i: x * (i + 1))
    return F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 6) + 0.0


def vector_rows(df):
    return df.select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("dim"),
        F.col("embedding")[0].cast("double").alias("first_value"),
        F.element_at("embedding", -1).cast("double").alias("last_value"),
        place_sum(F.col("embedding")).alias("place_sum"),
    )


def packed(spark, sf):
    return table(spark, sf, "embeddings").select(
        binary.pack_key(F.col("vec_id")).alias("key"), binary.pack_vector(F.col("embedding")).alias("value")
    )


def unpacked(df):
    return df.select(binary.unpack_key(F.col("key")).alias("vec_id"), binary.unpack_vector(F.col("value")).alias("embedding"))


@query(VECTOR_ROWS)
def read_sequence_file(spark, sf):
    path = scratch(spark, "seqfile")
    binary.write_sequence_file(packed(spark, sf), path)
    return vector_rows(unpacked(binary.read_sequence_file(spark, path)))


@query(f"SELECT vec_id, len(embedding) * 4 + 8 AS n_bytes, {PLACE_SUM} AS place_sum FROM embeddings")
def write_embedding_seqfile(spark, sf):
    path = scratch(spark, "dump")
    binary.write_sequence_file(packed(spark, sf), path)
    back = binary.read_sequence_file(spark, path)
    rows = back.withColumn("n_bytes", (F.length("key") + F.length("value")).cast("bigint"))
    return rows.select(
        binary.unpack_key(F.col("key")).alias("vec_id"), "n_bytes", place_sum(binary.unpack_vector(F.col("value"))).alias("place_sum")
    )


@query(VECTOR_ROWS)
def read_raw_kv(spark, sf):
    path = scratch(spark, "rawkv")
    binary.write_raw_kv(packed(spark, sf), path)
    return vector_rows(unpacked(binary.read_raw_kv(spark, path)))


@query(f"SELECT vec_id, {PLACE_SUM} AS place_sum, true AS small_files FROM embeddings")
def write_raw_kv(spark, sf):
    """All pairs as they are read back, and whether no file has more than its 128."""
    path = scratch(spark, "rawkv")
    binary.write_raw_kv(packed(spark, sf), path, rows_per_file=128)
    # a pair of this table takes 8 key bytes, 256 value bytes and 8 length bytes
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length") <= 128 * 272).scalar()
    rows = unpacked(binary.read_raw_kv(spark, path))
    return rows.select("vec_id", place_sum(F.col("embedding")).alias("place_sum"), largest.alias("small_files"))


@query("""WITH c AS (SELECT *, dense_rank() OVER (ORDER BY l_orderkey // 1000) - 1 AS idx FROM lineitem)
SELECT l_orderkey // 1000 AS chunk, count(*) AS n_rows, sum(l_quantity) AS quantity FROM c WHERE idx % 3 = 1 GROUP BY ALL""")
def read_chunk_files(spark, sf):
    path = scratch(spark, "chunks")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    chunk = F.lpad(F.expr("l_orderkey div 1000").cast("string"), 12, "0")
    rows.withColumn("chunk", F.concat(F.lit("c"), chunk)).repartition("chunk").write.partitionBy("chunk").parquet(path)
    mine = files.read_chunk_files(spark, path, trainers=3, trainer_id=1)
    return mine.groupBy(F.substring("chunk", 2, 12).cast("bigint").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity")
    )


@query(rf"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g')), ' ') AS ws FROM documents),
  t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
  v AS (SELECT doc_id // 16 AS bucket, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY doc_id, pos) - 1 AS idx, word FROM t WHERE word <> '')
SELECT bucket, word, max(idx) AS idx FROM v GROUP BY bucket, word""")
def read_vocabulary(spark, sf):
    """Vocabulary files that hold every word of 16 documents, in the order of the texts."""
    path = scratch(spark, "vocabulary")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).withColumn("bucket", F.expr("doc_id div 16"))
    # the words of a text go out as one value of many lines; those of texts that share a number or have none take turns by place
    alone = (F.count(F.lit(1)).over(Window.partitionBy("bucket", "doc_id")) == 1) & F.col("doc_id").isNotNull()
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.array_join("words", "\n").alias("value")))
    single = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("value")))
    found = docs.withColumn("_alone", alone).withColumn("words", text.words(F.col("text"))).where(F.size("words") > 0)
    lines = found.select("doc_id", "bucket", F.inline(F.when(F.col("_alone"), whole).otherwise(single)))
    text.write_lines(lines, path, "bucket", ["doc_id", "pos"], "value")
    words = text.read_vocabulary(spark, path)
    return words.select(F.col("bucket").cast("bigint").alias("bucket"), "word", "idx")


@query("""SELECT vec_id, ((vec_id * 31) % 101) / 101.0 AS first_pixel,
       round(list_sum(list_transform(range(784), lambda i: ((vec_id * 31 + i * 17) % 101) / 101.0)), 6) AS pixel_sum,
       ((vec_id * 31 + 1) % 101) / 101.0 AS target FROM embeddings""")
def synthetic_samples(spark, sf):
    made = files.synthetic_samples(table(spark, sf, "embeddings"), "vec_id", {"img": [1, 28, 28], "label": [1]})
    return made.select(
        "vec_id",
        F.col("img")[0].alias("first_pixel"),
        F.round(F.aggregate("img", F.lit(0.0), lambda a, x: a + x), 6).alias("pixel_sum"),
        F.col("label")[0].alias("target"),
    )


@query("""SELECT 'embedding' AS feed, count(*) AS n_rows, count(*) FILTER (len(embedding) <> 64) AS bad_rows FROM embeddings""")
def declare_feed_schema(spark, sf):
    feeds = files.declare_feed_schema([("embedding", [8, 8], "float32")])
    samples = table(spark, sf, "embeddings")
    files.check_feed_schema(samples, feeds)
    return files.feed_violations(samples, feeds)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, true AS small_files FROM lineitem")
def write_chunks(spark, sf):
    """All rows as they are read back, and whether no file has more than its 5000."""
    path = scratch(spark, "chunks")
    files.write_chunks(table(spark, sf, "lineitem"), path, 5000)
    chunks = spark.read.parquet(path)
    sizes = chunks.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    small = sizes.agg(F.max("n") <= 5000).scalar()
    return chunks.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", small.alias("small_files")
    )


@query("""SELECT CASE WHEN vec_id % 2 = 0 THEN 'base' ELSE 'patch' END AS kind, '20240131' AS day, count(*) AS n_rows,
       '1706659200' AS id FROM embeddings GROUP BY ALL""")
def write_donefile(spark, sf):
    root = scratch(spark, "dump")
    kind = F.when(F.col("vec_id") % 2 == 0, "base").otherwise("patch")
    data = table(spark, sf, "embeddings").select("vec_id", kind.alias("kind"), F.lit("20240131").alias("day"))
    data.write.partitionBy("day", "kind").parquet(f"{root}/data")
    for name in ("base", "patch"):
        files.write_donefile(spark, f"{root}/donefile/{name}", 1706659200, f"{root}/data/day=20240131/kind={name}")
    done = spark.read.schema("id string, key string, input string").json([f"{root}/donefile/base", f"{root}/donefile/patch"])
    done = done.withColumn("kind", F.regexp_extract("input", "kind=([a-z]+)$", 1))
    counts = spark.read.parquet(f"{root}/data").groupBy("kind", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return counts.join(done, "kind").select("kind", "day", "n_rows", "id")


STATE = (
    "total_batch_size int, model_path string, data_checkpoint struct<reader_name:string,"
    "processed_data:map<string,array<struct<begin:bigint,end:bigint>>>>, train_status struct<epoch_no:bigint,"
    "global_step_no:bigint,status:int>"
)


@query("""WITH d AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, count(*) AS steps,
    min(event_id) AS b, max(event_id) AS e FROM events GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC) AS k FROM d)
SELECT 'user_' || user_id AS name, epoch AS version, steps AS global_step_no, b AS range_begin, e AS range_end,
       1000 AS total_batch_size FROM r WHERE k = 1""")
def save_load_state(spark, sf):
    path = scratch(spark, "state")
    epoch = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    days = table(spark, sf, "events").groupBy("user_id", epoch.alias("version")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("begin"), F.max("event_id").alias("end")
    )
    name = F.concat(F.lit("user_"), "user_id")
    states = days.select(
        name.alias("name"),
        "version",
        F.lit(1000).alias("total_batch_size"),
        F.concat(F.lit("model/"), "user_id").alias("model_path"),
        F.struct(
            name.alias("reader_name"),
            F.create_map(F.lit("0"), F.array(F.struct("begin", "end"))).alias("processed_data"),
        ).alias("data_checkpoint"),
        F.struct(F.col("version").alias("epoch_no"), F.col("n").alias("global_step_no"), F.lit(1).alias("status")).alias(
            "train_status"
        ),
    )
    files.save_state(states, path)
    ranges = F.col("data_checkpoint.processed_data")["0"][0]
    return files.load_state(spark, path, STATE).select(
        "name",
        "version",
        F.col("train_status.global_step_no").alias("global_step_no"),
        ranges["begin"].alias("range_begin"),
        ranges["end"].alias("range_end"),
        "total_batch_size",
    )


@query("""SELECT event_type, count(*) AS n_rows, round(sum(value), 4) AS total, 2 AS version FROM events GROUP BY event_type""")
def versioned_checkpoint(spark, sf):
    path = scratch(spark, "versions")
    events = table(spark, sf, "events")
    state = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))
    early = events.where(F.col("ts") < "2024-01-15").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total")
    )
    files.save_version(early, path, 1)
    files.save_version(state, path, 2)
    # version 3 stopped before its commit
    unfinished = f"{path}/version=3"
    early.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(unfinished)
    return files.load_version(spark, path)
