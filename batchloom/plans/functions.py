"""Queries: scalar functions on text, bytes, maps, JSON, tensors and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.functions import scalars, tensors
from batchloom.operators.positions import id_positions
from batchloom.operators.ranges import range_text as text_of_range
from batchloom.plans.batching import WORDS, array_sum
from batchloom.plans.registry import query
from batchloom.plans.scoring import place_sum, place_sum_sql
from batchloom.session import table
from batchloom.sources import binary
from batchloom.sources.text import words


@query(r"""SELECT page_id, split_part(split_part(url, '/', 3), ':', 1) AS host, TRY_CAST(regexp_extract('h:' || (8000 + page_id), ':(\d+)$', 1) AS INTEGER) AS port,
  page_id::INTEGER AS low, (page_id * 2)::INTEGER AS high, substr(url, instr(url, '//') + 2) AS path FROM pages""")
def string_parse(spark, sf):
    pages = table(spark, sf, "pages")
    pair = scalars.bounds(F.concat_ws(":", F.col("page_id").cast("string"), (F.col("page_id") * 2).cast("string")))
    scheme = F.regexp_extract("url", "^[a-z]+://", 0)
    return pages.select(
        "page_id",
        scalars.host(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"),
        scalars.port(F.concat(F.lit("h:"), (F.col("page_id") + 8000).cast("string"))).alias("port"),
        pair["low"].alias("low"),
        pair["high"].alias("high"),
        scalars.strip_prefix(F.col("url"), scheme).alias("path"),
    )


@query("""SELECT s_suppkey, '/root/nation_' || s_nationkey || '/nodes/' || s_name AS path,
  'Pass ' || s_nationkey || ', trainbatch ' || s_suppkey || ', loss ' || printf('%.5f', s_acctbal) AS metric FROM supplier""")
def string_build(spark, sf):
    service = F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        scalars.service_path(F.lit("root"), service, F.col("s_name")).alias("path"),
        F.format_string("Pass %d, trainbatch %d, loss %.5f", "s_nationkey", "s_suppkey", "s_acctbal").alias("metric"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS digest, CASE WHEN doc_id % 5 <> 0 THEN length(text) END AS n FROM documents")
def bytes_text(spark, sf):
    raw = F.when(F.col("doc_id") % 5 != 0, F.encode("text", "utf-8"))
    decoded = table(spark, sf, "documents").select("doc_id", scalars.bytes_text(raw).alias("text"))
    return decoded.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("""SELECT p_partkey, 'var_' || p_brand || '_' || (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS name FROM part""")
def unique_names(spark, sf):
    numbered = id_positions(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", ["p_brand"], "n")
    return numbered.select("p_partkey", F.concat(F.lit("var_"), "p_brand", F.lit("_"), F.col("n").cast("string")).alias("name"))


@query("""SELECT 'idx_in_list:' || l_suppkey || ', file_path:part-' || l_suppkey || ' record:[' ||
  array_to_string(list_transform(range(l_orderkey, l_orderkey + l_linenumber), lambda n: '(record_no:' || n || ')'), '') || ']' AS text FROM lineitem""")
def range_text(spark, sf):
    path = F.concat(F.lit("part-"), F.col("l_suppkey").cast("string"))
    end = F.col("l_orderkey") + F.col("l_linenumber") - 1
    return table(spark, sf, "lineitem").select(text_of_range(F.col("l_suppkey"), path, F.col("l_orderkey"), end).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 0.0 WHEN 1 THEN l_quantity ELSE round(0.001 * (l_quantity * 10), 6) END AS cpu FROM lineitem""")
def cpu_quantity(spark, sf):
    number = F.col("l_quantity").cast("int")
    request = F.when(F.col("l_linenumber") % 3 == 1, number.cast("string")).when(
        F.col("l_linenumber") % 3 == 2, F.concat((number * 10).cast("string"), F.lit("m"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(scalars.cpu_quantity(request), 6).alias("cpu")
    )


NORM = "(embedding[i + 1]::DOUBLE / 255.0 - [0.485, 0.456, 0.406, 0.4][i // 16 + 1]) / [0.229, 0.224, 0.225, 0.2][i // 16 + 1]"


@query(f"""SELECT vec_id, {place_sum_sql(f'list_transform(range(64), lambda i: {NORM})')} AS normal,
  {place_sum_sql('list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE / 255.0 * 2 - 1)')} AS unit,
  {place_sum_sql('list_transform(range(64), lambda i: embedding[i - i % 4 + 3 - i % 4 + 1]::DOUBLE)')} AS reversed,
  {place_sum_sql('list_transform(range(64), lambda i: embedding[i % 16 * 4 + i // 16 + 1]::DOUBLE)')} AS planar,
  {place_sum_sql('list_transform(range(64), lambda i: embedding[i - i % 8 + 7 - i % 8 + 1]::DOUBLE)')} AS mirrored FROM embeddings""")
def tensor_normalise(spark, sf):
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        place_sum(tensors.normalise(x, [0.485, 0.456, 0.406, 0.4], [0.229, 0.224, 0.225, 0.2], 16)).alias("normal"),
        place_sum(tensors.to_unit_range(x)).alias("unit"),
        place_sum(tensors.reverse_channels(x, 16, 4)).alias("reversed"),
        place_sum(tensors.channels_first(x, 16, 4)).alias("planar"),
        place_sum(tensors.mirror(x, 8, 8)).alias("mirrored"),
    )


@query(f"""SELECT vec_id, true AS fits, false AS fits_other, {place_sum_sql('list_transform(range(16), lambda i: embedding[(i // 4 + 2) * 8 + i % 4 + 2 + 1]::DOUBLE)')} AS crop FROM embeddings""")
def tensor_reshape_crop(spark, sf):
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        tensors.reshape(x, [1, 8, 8]).isNotNull().alias("fits"),
        tensors.reshape(x, [3, 8, 8]).isNotNull().alias("fits_other"),
        place_sum(tensors.center_crop(x, 8, 8, 4)).alias("crop"),
    )


@query(f"""SELECT vec_id, 8 AS key_bytes, 256 AS value_bytes, vec_id AS key_back, {place_sum_sql('embedding::DOUBLE[]')} AS vector_back FROM embeddings""")
def pack_vector(spark, sf):
    packed = table(spark, sf, "embeddings").select(
        "vec_id", binary.pack_key(F.col("vec_id")).alias("key"), binary.pack_vector(F.col("embedding")).alias("value")
    )
    return packed.select(
        "vec_id",
        F.length("key").alias("key_bytes"),
        F.length("value").alias("value_bytes"),
        binary.unpack_key(F.col("key")).alias("key_back"),
        place_sum(binary.unpack_vector(F.col("value")).cast("array<double>")).alias("vector_back"),
    )


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 'k,type,user' AS names, 'user_' || user_id AS user_label,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n_bad FROM events""")
def map_ops(spark, sf):
    labels = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.map_from_arrays(F.array(F.lit("type"), F.lit("user")), F.array(F.col("event_type"), F.col("user_id").cast("string"))),
    )
    tagged = F.transform_values("labels", lambda k, v: F.when(k == "user", F.concat(F.lit("user_"), v)).otherwise(v))
    return table(spark, sf, "events").select("event_id", labels.alias("labels")).select(
        "event_id",
        F.col("labels")["k"].alias("k"),
        F.array_join(F.sort_array(F.map_keys("labels")), ",").alias("names"),
        tagged["user"].alias("user_label"),
        F.size(F.map_filter("labels", lambda k, v: v == "error")).alias("n_bad"),
    )


@query("""SELECT event_id, user_id AS epoch_no, (json_extract_string(props, '$.k'))::BIGINT AS world_size,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END AS step_num FROM events""")
def json_nested(spark, sf):
    """Train state with its epochs as JSON text inside JSON text, integer keys and an absent member."""
    attribute = F.to_json(F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("world_size"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("step_num"),
        F.lit("x").alias("unknown_member"),
    ))
    epochs = F.to_json(F.create_map(F.col("user_id").cast("string"), attribute))
    state = F.to_json(F.struct(F.col("user_id").alias("_epoch_no"), epochs.alias("_epochs")))
    outer = F.from_json(state, "_epoch_no bigint, _epochs string")
    rows = table(spark, sf, "events").select("event_id", outer.alias("s")).select("event_id", "s.*")
    by_epoch = F.from_json("_epochs", "map<string,string>")
    inner = F.from_json(by_epoch[F.col("_epoch_no").cast("string")], "world_size bigint, step_num bigint, avg_step_time double")
    return rows.select("event_id", F.col("_epoch_no").alias("epoch_no"), inner.alias("a")).select(
        "event_id", "epoch_no", "a.world_size", F.coalesce("a.step_num", F.lit(0)).alias("step_num")
    )


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS day, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000 AS millis FROM events")
def time_stamps(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", scalars.day_stamp(ts).alias("day"), scalars.epoch_seconds(ts).alias("seconds"), scalars.epoch_millis(ts).alias("millis")
    )


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 1 ELSE 2 END AS code,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS name,
  CASE o_orderstatus WHEN 'F' THEN 'KILLED' WHEN 'O' THEN 'RUNNING' ELSE 'N/A' END AS report,
  CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 END AS train_code FROM orders""")
def status_codes(spark, sf):
    status = F.col("o_orderstatus")
    pick = lambda f, o, p: F.when(status == "F", f).when(status == "O", o).otherwise(p)
    code = scalars.status_code(pick("FAILED", "RUNNING", "PENDING"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        code.alias("code"),
        scalars.status_name(code).alias("name"),
        scalars.job_text(pick("killed", "running", "not exists")).alias("report"),
        scalars.train_status_code(pick("FAILED", "NEARTHEEND", "PENDING")).alias("train_code"),
    )


@query(f"""WITH d AS (SELECT doc_id, list_transform({WORDS}, lambda w: length(w)) AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS task_id FROM documents d),
  w AS (SELECT doc_id, ids, unnest(range(greatest(1, ceil(len(ids) / 256.0))::BIGINT)) AS window_no FROM d),
  c AS (SELECT doc_id, window_no, list_slice(ids, window_no * 256 + 1, (window_no + 1) * 256) AS ids FROM w)
SELECT doc_id, window_no, 256 AS padded, len(ids) AS mask_sum, coalesce(list_sum(ids), 0)::BIGINT AS id_sum, (len(ids) * (len(ids) - 1)) // 2 AS position_sum, 0 AS segment_sum FROM c""")
def model_features(spark, sf):
    """Model inputs in windows of 256 ids: padded ids, positions, segments and mask."""
    from batchloom.functions.features import model_features as features

    ids = F.transform(words(F.col("text")), lambda w: F.length(w).cast("bigint"))
    rows = features(table(spark, sf, "documents").select("doc_id", ids.alias("ids")), "ids", 256)
    return rows.select(
        "doc_id",
        F.col("window_no").cast("bigint").alias("window_no"),
        F.size("input_ids").alias("padded"),
        array_sum(F.col("input_mask")).alias("mask_sum"),
        array_sum(F.col("input_ids")).alias("id_sum"),
        array_sum(F.col("position_ids")).alias("position_sum"),
        array_sum(F.col("segment_ids")).alias("segment_sum"),
    )
