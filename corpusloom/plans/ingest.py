"""Queries of sources and sinks (S) and of incremental ingestion (T). File formats are written from the tables
to scratch and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph as gr
from ..operators import quality as q
from ..registry import operator, table
from ..sources import readers as r
from ..streaming import incremental as inc
from ..streaming import online_dedup, progress, shuffle
from . import sql as s


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@operator("s01_jsonl_scan", "SELECT doc_id, lang, n_chars, sha256(text) AS h FROM documents")
def s01(spark, d):
    path = r.scratch(spark, "jsonl")
    _docs(spark, d).write.json(path)
    return r.read_jsonl(spark, path, SCHEMA).select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))


@operator("s02_tolerant_jsonl_scan", "SELECT CAST(count(*) FILTER (WHERE doc_id % 10 = 0) AS BIGINT) AS bad, CAST(count(*) FILTER (WHERE doc_id % 10 <> 0) AS BIGINT) AS good FROM documents")
def s02(spark, d):
    path = r.scratch(spark, "bad-jsonl")
    line = F.to_json(F.struct("doc_id", "lang"))
    _docs(spark, d).select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    rows = r.read_jsonl(spark, path, "doc_id long, lang string", strict=False).select("doc_id", F.col("_bad").isNotNull().alias("bad"))
    return rows.agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good"))


@operator("s03_csv_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS h FROM documents")
def s03(spark, d):
    path = r.scratch(spark, "csv")
    as_is = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _docs(spark, d).select("doc_id", "text").write.options(**as_is).csv(path)
    return r.read_csv(spark, path).select("doc_id", F.sha2("text", 256).alias("h"))


@operator("s04_tsv_scan_positional", "SELECT CAST(count(*) FILTER (WHERE page_id % 9 = 0) AS BIGINT) AS bad, count(*) AS n FROM pages WHERE page_id % 5 <> 0")
def s04(spark, d):
    path = r.scratch(spark, "tsv")
    i = F.col("page_id")
    extra = F.when(i % 9 == 0, F.lit("\textra")).otherwise("")
    line = F.concat(F.when(i % 5 == 0, "# ").otherwise(""), i.cast("string"), F.lit("\t"), "url", extra)
    table(spark, d, "pages").select(line.alias("value")).write.text(path)
    return r.read_tsv(spark, path, ["page_id", "url"]).agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))


@operator("s05_parquet_batch_scan", "SELECT source, count(*) AS n FROM documents WHERE n_chars >= 1000 GROUP BY source")
def s05(spark, d):
    return table(spark, d, "documents").where("n_chars >= 1000").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@operator("s06_nested_document_flatten", "SELECT conv_id, turn, sha256(text) AS h, CAST(length(text) AS BIGINT) AS answer_end FROM conversations")
def s06(spark, d):
    item = F.struct("turn", "text", F.length("text").cast("long").alias("answer_end"))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("qas"))
    flat = nested.select("conv_id", F.explode("qas").alias("qa"))
    return flat.select("conv_id", "qa.turn", F.sha2("qa.text", 256).alias("h"), "qa.answer_end")


_EDGES = "'^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'"


@operator(
    "s07_sectioned_text_parse",
    f"""WITH d AS (SELECT doc_id, lang, regexp_replace(text, {_EDGES}) AS v, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source FROM documents), n AS (SELECT unnest([0, 1]) AS place)
    SELECT doc_id, place, lang AS section, unnest(['SOURCE', 'TEXT']) AS kind, sha256(unnest([source, v])) AS value FROM d, n WHERE place = 0 OR doc_id % 10 = 0
    UNION ALL SELECT doc_id, place, lang, 'flag', sha256(CASE WHEN doc_id % 9 = 0 THEN 'severe' ELSE 'low' END || '/length/a|b') FROM d, n WHERE place = 0 OR doc_id % 10 = 0
    UNION ALL SELECT doc_id, 0, lang, 'fault', sha256('repeated section') FROM d WHERE doc_id % 10 = 0
    UNION ALL SELECT doc_id, 0, lang, 'fault', sha256('empty SOURCE') FROM d, n WHERE doc_id % 7 = 0 AND (place = 0 OR doc_id % 10 = 0)
    UNION ALL SELECT doc_id, 0, lang, 'fault', sha256('empty TEXT') FROM d, n WHERE v = '' AND (place = 0 OR doc_id % 10 = 0)
    UNION ALL SELECT doc_id, 0, lang, 'fault', sha256('bad flag') FROM d, n WHERE doc_id % 9 = 0 AND (place = 0 OR doc_id % 10 = 0)""",
)
def s07(spark, d):
    """Whole texts as blocks, header-like lines in them escaped; some sections stand twice, some sources are
    empty, some flags are none."""
    n = F.col("doc_id")
    value = r.escaped_lines(F.concat(F.lit("=== x\n"), F.lit("@@"), F.lit("\n"), "text"))
    flag = F.concat(F.when(n % 9 == 0, "severe").otherwise("low"), F.lit(" | length|a|b\n"))
    body = F.concat(F.lit("@@SOURCE\n"), F.when(n % 7 == 0, "").otherwise(F.col("source")), F.lit("\n@@TEXT\n"), value, F.lit("\n@@FLAGS\n\n"), flag)
    section = F.concat(F.lit("=== "), "lang", F.lit("\n"), body)
    docs = _docs(spark, d).select("doc_id", F.concat(F.lit("a title\n"), section, F.when(n % 10 == 0, section).otherwise("")).alias("x"))
    parsed = r.parse_sections(docs, "doc_id", "x")
    # the two lines that stand before each text prove the escape; they are taken off again
    blocks = parsed.select("doc_id", "place", "section", F.explode("fields").alias("f")).where("f.field <> 'FLAGS'")
    text = F.regexp_replace(F.regexp_replace("f.value", r"^=== x\n@@(\n|$)", ""), r"^[ \t\n\r\f]+", "")
    values = blocks.select("doc_id", "place", "section", F.col("f.field").alias("kind"), F.when(F.col("f.field") == "TEXT", text).otherwise(F.col("f.value")).alias("value"))
    flags = r.section_flags(parsed, "doc_id").select("doc_id", "place", "section", F.lit("flag").alias("kind"), F.concat_ws("/", "severity", "type", "note").alias("value"))
    # the fields of an empty text hold the two lines, so its fault is told by the value
    required = r.section_faults(parsed, "doc_id", ["SOURCE", "TEXT"]).select("doc_id", F.lit(0).alias("place"), "section", F.lit("fault").alias("kind"), F.col("fault").alias("value"))
    empty = values.where("kind = 'TEXT' and value = ''").select("doc_id", F.lit(0).alias("place"), "section", F.lit("fault").alias("kind"), F.lit("empty TEXT").alias("value"))
    return values.union(flags).union(required).union(empty).withColumn("value", F.sha2("value", 256))


@operator("s08_recursive_prompt_harvest", "SELECT conv_id, text AS prompt FROM conversations WHERE role = 'user' UNION ALL SELECT DISTINCT conv_id, 'top' FROM conversations")
def s08(spark, d):
    messages = F.collect_list(F.struct("role", F.col("text").alias("content")))
    # a list of objects, the conversation in an object inside, the question three levels down
    conversation = F.struct(messages.alias("messages"))
    question = F.struct(F.array(F.struct(F.lit("top").alias("question"))).alias("items"))
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.to_json(F.array(F.to_json(F.struct(conversation.alias("run"))), F.to_json(F.struct(question.alias("extra"))))).alias("j")
    )
    whole = whole.select("conv_id", F.concat(F.lit("["), F.array_join(F.from_json("j", "array<string>"), ","), F.lit("]")).alias("j"))
    return r.harvest_prompts(whole, "conv_id", "j")


@operator("s09_pinned_source_verify", "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob, strlen(text) AS size FROM documents")
def s09(spark, d):
    return _docs(spark, d).select("doc_id", r.git_blob_sha1(F.col("text")).alias("blob"), F.octet_length("text").cast("long").alias("size"))


@operator("s10_frozen_write", "SELECT TRUE AS wrote, FALSE AS again, TRUE AS refused")
def s10(spark, d):
    path = r.scratch(spark, "frozen")
    docs = _docs(spark, d).select("doc_id", "lang")
    wrote, again, refused = r.frozen_write(docs, path), r.frozen_write(docs, path), False
    try:
        r.frozen_write(docs.withColumn("lang", F.upper("lang")), path)
    except ValueError:
        refused = True
    return spark.createDataFrame([(wrote, again, refused)], "wrote boolean, again boolean, refused boolean")


@operator("s11_manifest_sink", "SELECT count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents")
def s11(spark, d):
    return r.manifest(_docs(spark, d), "doc_id").select("rows", "first_id", "last_id")


@operator("s12_csv_dual_export", "SELECT count(*) AS json_rows, count(*) AS csv_rows FROM labels")
def s12(spark, d):
    labels = table(spark, d, "labels").withColumn("nested", F.struct("quality", "toxic"))
    a, b = r.scratch(spark, "dual-json"), r.scratch(spark, "dual-csv")
    labels.write.json(a)
    labels.drop("nested").write.option("header", True).csv(b)
    one = spark.read.schema("doc_id long").json(a).agg(F.count(F.lit(1)).alias("json_rows"))
    return one.crossJoin(r.read_csv(spark, b).agg(F.count(F.lit(1)).alias("csv_rows")))


@operator("s13_field_allowlist_projection", "SELECT conv_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')")
def s13(spark, d):
    return table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", F.col("text").alias("content"))


@operator(
    "s14_archive_pack_verify",
    """SELECT 'documents/' || doc_id || '.txt' AS name, strlen(replace(text, chr(13) || chr(10), chr(10))) AS size,
    sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256, doc_id % 50 <> 1 AS ok FROM documents""",
)
def s14(spark, d):
    """Documents, with line ends made one, as members of tar archives of about 16 MB, written and read again;
    members are held against sizes and hashes taken from the table, some of which are spoiled on purpose."""
    docs = _docs(spark, d).select("doc_id", F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("content"))
    archives = int(docs.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // (16 << 20) + 1
    path = r.scratch(spark, "pack")
    r.pack_archives(docs, "name", "content", archives).write.parquet(path)
    size, digest = F.octet_length("content").cast("long"), F.sha2("content", 256)
    spoiled = F.when(F.col("doc_id") % 50 == 1, F.lit("spoiled")).otherwise(digest)
    declared = docs.select("name", size.alias("size"), spoiled.alias("sha256"))
    return r.verify_archives(spark.read.schema("archive int, data binary").parquet(path), declared)


@operator("s15_hash_bound_review_import", "SELECT doc_id, doc_id % 6 <> 0 AS accepted FROM labels")
def s15(spark, d):
    docs = _docs(spark, d).select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source", "text")), 256).alias("record"))
    stored = table(spark, d, "labels").select("doc_id").join(docs, "doc_id")
    reviews = stored.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.lit("changed")).otherwise(F.col("record")).alias("reviewed"))
    return docs.join(reviews, "doc_id").select("doc_id", (F.col("record") == F.col("reviewed")).alias("accepted"))


@operator(
    "s16_text_canonical_copy",
    "SELECT doc_id, sha256(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS h FROM documents",
)
def s16(spark, d):
    wild = F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return _docs(spark, d).select("doc_id", F.sha2(r.canonical_text(wild), 256).alias("h"))


@operator(
    "s17_hidden_reference_split",
    "SELECT conv_id, 'request' AS part, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE role <> 'assistant' GROUP BY conv_id UNION ALL SELECT conv_id, 'reference', CAST(count(*) AS BIGINT) FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
)
def s17(spark, d):
    part = F.when(F.col("role") == "assistant", "reference").otherwise("request")
    return table(spark, d, "conversations").groupBy("conv_id", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@operator(
    "s18_junit_counts",
    "SELECT user_id, count(*) AS tests, CAST(sum(CAST(value > 80 AS INTEGER)) AS BIGINT) AS failures, CAST(sum(CAST(value <= 80 AS INTEGER)) AS BIGINT) AS passed FROM events GROUP BY user_id",
)
def s18(spark, d):
    """Suites as XML, read by XPath."""
    case = F.concat(F.lit("<testcase>"), F.when(F.col("value") > 80, "<failure/>").otherwise(""), F.lit("</testcase>"))
    suites = table(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit("<testsuite>"), F.concat_ws("", F.collect_list(case)), F.lit("</testsuite>")).alias("x"))
    count = lambda p: F.xpath_long("x", F.lit(f"count({p})"))
    return suites.select(
        "user_id", count("//testcase").alias("tests"), count("//failure").alias("failures"), (count("//testcase") - count("//failure")).alias("passed")
    )


@operator("t01_bounded_shuffle_stream", "SELECT count(*) AS n, min(sha256('stream:' || doc_id)) AS first FROM documents")
def t01(spark, d):
    """Documents as a file stream, four files a batch, with a shuffle key."""
    src, out = r.scratch(spark, "stream-in"), r.scratch(spark, "stream-out")
    docs = _docs(spark, d).select("doc_id", "lang")
    docs.repartition(8).write.parquet(src)
    inc.run_to_table(inc.bounded_shuffle(inc.read_stream(spark, src, docs.schema, 4), "stream", "doc_id"), out, r.scratch(spark, "checkpoint"))
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.min("shuffle_key").alias("first"))


def _numbered_files(spark, docs, key, parts: int, by: str = "place"):
    """docs dealt into ``parts`` ranges of ``key``, one file each, written in order of age."""
    src = r.scratch(spark, "stream-in")
    ranged = docs.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id())
    held = gr.checkpointed(ranged)
    for i in range(parts):
        held.where(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(src)
    gr.drop(held)
    return src


@operator("t01_buffered_shuffle")
def t01_buffered(spark, d):
    """Documents of each language as a stream that passes a buffer of 256 rows: language, place, place in the source, id."""
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("doc_id").alias("seq"), F.lit(False).alias("end"), "doc_id")
    ends = docs.select("lang").distinct().select("lang", F.lit((1 << 63) - 1).alias("seq"), F.lit(True).alias("end"), F.lit(None).cast("long").alias("doc_id"))
    src, out = _numbered_files(spark, docs.unionByName(ends), "seq", 6), r.scratch(spark, "stream-out")
    stream = shuffle.bounded_shuffle(inc.read_stream(spark, src, docs.schema, 2), "lang", "seq", "end", "stream", 256)
    inc.run_to_table(stream, out, r.scratch(spark, "checkpoint"))
    return spark.read.parquet(out).select("lang", "place", "source_place", "doc_id")


@operator("t02_online_near_dedup")
def t02_near(spark, d):
    """Ids that are kept when documents come as a stream in order of id, two files a batch: neither texts nor long
    paragraphs nor near copies (anchors of 8-grams) of what has been kept come again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("rank"), "text")
    found = online_dedup.run(spark, _numbered_files(spark, docs, "rank", 4), r.scratch(spark, "kept"), 2)
    return found.select(F.col("rank").alias("doc_id"))


@operator("t02_stateful_online_dedup", "SELECT DISTINCT sha256(text) AS h FROM documents")
def t02(spark, d):
    src, out = r.scratch(spark, "dedup-in"), r.scratch(spark, "dedup-out")
    hashes = _docs(spark, d).select(F.sha2("text", 256).alias("h"))
    hashes.repartition(4).write.parquet(src)
    inc.run_to_table(inc.online_dedup(inc.read_stream(spark, src, hashes.schema, 2), "h"), out, r.scratch(spark, "checkpoint"))
    return spark.read.parquet(out).select("h")


@operator("t03_progressive_append", "SELECT 4 AS batches, count(*) AS rows, 'completed' AS status FROM labels")
def t03(spark, d):
    src, out = r.scratch(spark, "append-in"), r.scratch(spark, "append-out")
    labels = table(spark, d, "labels")
    labels.repartition(4).write.parquet(src)
    done = progress.append(inc.read_stream(spark, src, labels.schema, 1), out, {"table": "labels"})
    return spark.createDataFrame([(done["batches"], done["count"], done["status"])], "batches int, rows long, status string")


@operator(
    "t06_batch_progress",
    "SELECT b AS batch, CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS accepted, CAST(sum(n) OVER (ORDER BY b) // 100 - (sum(n) OVER (ORDER BY b) - n) // 100 AS BIGINT) AS reports FROM (SELECT doc_id % 5 AS b, count(*) AS n FROM documents GROUP BY b)",
)
def t06_batches(spark, d):
    """Documents appended in five batches: rows so far, and how often another hundred was full."""
    src, out = r.scratch(spark, "append-in"), r.scratch(spark, "append-out")
    docs = _docs(spark, d).select("doc_id", "lang")
    for i in range(5):
        docs.where(F.col("doc_id") % 5 == i).coalesce(1).write.mode("append").parquet(src)
    progress.append(inc.read_stream(spark, src, docs.schema, 1), out)
    return progress.rollup(spark, out, 100)


@operator("t06_cumulative_progress_rollup", f"SELECT b AS block, CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS accepted FROM (SELECT doc_id // 100 AS b, count(*) AS n FROM documents WHERE length({s.blank('text')}) BETWEEN 500 AND 20000 GROUP BY b)")
def t06(spark, d):
    """Accepted documents after each hundred ids: blocks are counted first, their counts summed after."""
    from pyspark.sql import Window

    blocks = _docs(spark, d).where(q.length_band("text")).groupBy(F.floor(F.col("doc_id") / 100).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return blocks.select("block", F.sum("n").over(Window.orderBy("block")).alias("accepted"))
